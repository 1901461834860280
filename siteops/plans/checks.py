"""The same results in plain SQL over the same tables, for comparison in another engine."""

from __future__ import annotations

# Events with the user's newest signup so far.
_EV = """
ev AS (
  SELECT user_id, ts, event_id AS seq, event_type, value, props,
         last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
           OVER (PARTITION BY user_id ORDER BY ts, event_id) AS newest
  FROM events
)"""

_REPLAY_1 = f"""
WITH {_EV},
seg AS (
  SELECT user_id, newest, min(ts) FILTER (event_type = 'signup') AS added_at,
         min(ts) FILTER (event_type IN ('click', 'error')) + INTERVAL 1 DAY AS expires_at,
         min(ts) FILTER (event_type = 'purchase') AS cleared_at
  FROM ev WHERE newest IS NOT NULL GROUP BY user_id, newest
),
nxt AS (
  SELECT *, lead(added_at) OVER (PARTITION BY user_id ORDER BY added_at, newest) AS next_at FROM seg
),
fate AS (
  SELECT *, least(expires_at, cleared_at, next_at) AS removed_at FROM nxt
),
opens AS (
  SELECT f.user_id, f.newest, arg_max(e.event_type <> 'click' AND e.event_type <> 'error', e.ts) AS open
  FROM fate f JOIN ev e ON e.user_id = f.user_id AND e.newest = f.newest
  WHERE (f.removed_at IS NULL OR e.ts < f.removed_at)
    AND (e.event_type IN ('signup', 'click', 'error') OR (e.event_type = 'view' AND e.value > 30))
  GROUP BY f.user_id, f.newest
),
notes AS (
  SELECT user_id, newest, note FROM (
    SELECT f.user_id, f.newest,
           CASE WHEN e.event_type = 'signup' THEN 'new' WHEN e.value >= 5 THEN e.props END AS note,
           row_number() OVER (PARTITION BY f.user_id, f.newest ORDER BY e.ts DESC) AS rn
    FROM fate f JOIN ev e ON e.user_id = f.user_id AND e.newest = f.newest
    WHERE (f.removed_at IS NULL OR e.ts < f.removed_at)
      AND (e.event_type = 'signup' OR (e.event_type = 'view' AND e.value <= 30))
  ) WHERE rn = 1
)
SELECT f.user_id, CAST(f.newest AS VARCHAR) AS id, f.added_at, f.removed_at,
       CASE WHEN f.expires_at <= f.removed_at THEN 'expiry'
            WHEN f.cleared_at <= f.removed_at THEN 'remove'
            WHEN f.next_at <= f.removed_at THEN 'evict' END AS cause,
       o.open, n.note
FROM fate f JOIN opens o USING (user_id, newest) JOIN notes n USING (user_id, newest)"""

# With three rows per store, a row outlives its successors' arrival: by-id actions reach it only
# while it is the newest, actions on all reach it as long as it is stored.
_REPLAY_3 = f"""
WITH {_EV},
adds AS (SELECT user_id, seq AS id, ts AS added_at FROM ev WHERE event_type = 'signup'),
goes AS (
  SELECT a.user_id, a.id, a.added_at,
         min(e.ts) FILTER (e.event_type = 'error' OR (e.event_type = 'click' AND e.newest = a.id))
           + INTERVAL 1 DAY AS expires_at,
         min(e.ts) FILTER (e.event_type = 'purchase' AND e.newest = a.id) AS cleared_at
  FROM adds a LEFT JOIN ev e ON e.user_id = a.user_id AND e.ts > a.added_at
  GROUP BY a.user_id, a.id, a.added_at
),
nat AS (SELECT *, least(expires_at, cleared_at) AS goes_at FROM goes),
crowd AS (
  SELECT r.user_id, r.id, j.added_at AS pushed_at, count(*) AS n
  FROM nat r
  JOIN nat j ON j.user_id = r.user_id AND j.added_at > r.added_at
  JOIN nat i ON i.user_id = r.user_id AND i.added_at > r.added_at AND i.added_at <= j.added_at
   AND (i.goes_at IS NULL OR i.goes_at > j.added_at)
  WHERE r.goes_at IS NULL OR r.goes_at > j.added_at
  GROUP BY r.user_id, r.id, j.added_at
),
ev3 AS (SELECT user_id, id, min(pushed_at) AS evicted_at FROM crowd WHERE n >= 3 GROUP BY user_id, id),
fate AS (
  SELECT nat.*, evicted_at, coalesce(evicted_at, goes_at) AS removed_at
  FROM nat LEFT JOIN ev3 USING (user_id, id)
),
live AS (
  SELECT f.user_id, f.id, e.ts, e.event_type, e.value, e.props
  FROM fate f JOIN ev e ON e.user_id = f.user_id AND e.ts >= f.added_at
  WHERE (f.removed_at IS NULL OR e.ts < f.removed_at) AND (e.newest = f.id OR e.event_type = 'error')
),
opens AS (
  SELECT user_id, id, arg_max(event_type <> 'click' AND event_type <> 'error', ts) AS open
  FROM live
  WHERE event_type IN ('signup', 'click', 'error') OR (event_type = 'view' AND value > 30)
  GROUP BY user_id, id
),
notes AS (
  SELECT user_id, id, note FROM (
    SELECT user_id, id,
           CASE WHEN event_type = 'signup' THEN 'new' WHEN value >= 5 THEN props END AS note,
           row_number() OVER (PARTITION BY user_id, id ORDER BY ts DESC) AS rn
    FROM live WHERE event_type = 'signup' OR (event_type = 'view' AND value <= 30)
  ) WHERE rn = 1
)
SELECT f.user_id, CAST(f.id AS VARCHAR) AS id, f.added_at, f.removed_at,
       CASE WHEN f.evicted_at IS NOT NULL THEN 'evict'
            WHEN f.expires_at <= f.removed_at THEN 'expiry'
            WHEN f.cleared_at <= f.removed_at THEN 'remove' END AS cause,
       o.open, n.note
FROM fate f JOIN opens o USING (user_id, id) JOIN notes n USING (user_id, id)"""

# The stream has seen everything up to its last watermark, which is in whole milliseconds.
_SEEN = "(SELECT date_trunc('millisecond', max(ts)) FROM events)"

#: The same over some kinds of events: a stream's watermark only sees what its filters leave.
_SEEN_OF = "(SELECT date_trunc('millisecond', max(ts)) FROM events WHERE event_type {})"

_STREAM_FATES = f"""
SELECT user_id, id, added_at, removed_at, cause FROM ({_REPLAY_1}) WHERE removed_at <= {_SEEN}"""

_SESSIONS = """
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events
FROM (
  SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS run
  FROM (
    SELECT user_id, ts,
           CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL {gap} HOUR
                THEN 0 ELSE 1 END AS opens
    FROM events
  )
) GROUP BY user_id, run"""

_MENUS = """
WITH enters AS (
  SELECT user_id, ts, event_id, event_type AS label,
         lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_at
  FROM events WHERE event_type IN ('signup', 'view')
),
visits AS (
  SELECT e.user_id, e.ts, e.event_id, e.label, e.next_at, min(l.ts) + INTERVAL 6 HOUR AS due
  FROM enters e LEFT JOIN events l
    ON l.user_id = e.user_id AND l.event_type IN ('click', 'error')
   AND l.ts > e.ts AND (e.next_at IS NULL OR l.ts < e.next_at)
  GROUP BY ALL
),
chained AS (
  SELECT *, CASE WHEN due IS NOT NULL AND (next_at IS NULL OR next_at >= due) THEN due ELSE next_at END
              AS ends,
         CASE WHEN lag(label) OVER w = label AND (lag(due) OVER w IS NULL OR lag(due) OVER w > ts)
              THEN 0 ELSE 1 END AS opens
  FROM visits WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM chained
)
SELECT user_id, any_value(label) AS label, min(ts) AS opened_at,
       CASE WHEN max(CASE WHEN ends IS NULL THEN 1 ELSE 0 END) = 1 THEN NULL ELSE max(ends) END
         AS closed_at
FROM runs GROUP BY user_id, run"""

_CHANGES = """
SELECT user_id, ts, seq, is_low FROM (
  SELECT user_id, ts, event_id AS seq, value < 76.8 AS is_low,
         lag(value < 76.8) OVER w AS prior, row_number() OVER w AS rn
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
) WHERE rn > 1 AND prior IS DISTINCT FROM is_low"""

_PANELS = """
WITH t AS (
  SELECT user_id, CASE WHEN value >= 12 THEN 'desktop' ELSE 'mobile' END AS device, ts,
         event_id AS seq, event_type = 'click' AS flips, value > 20 AS given
  FROM events WHERE event_type IN ('click', 'error')
),
n AS (
  SELECT *, sum(CASE WHEN flips THEN 1 ELSE 0 END) OVER w AS total
  FROM t WINDOW w AS (PARTITION BY user_id, device ORDER BY ts, seq)
),
b AS (
  SELECT *, last_value(CASE WHEN NOT flips THEN total END IGNORE NULLS) OVER w AS base_total,
         last_value(CASE WHEN NOT flips THEN given END IGNORE NULLS) OVER w AS base
  FROM n WINDOW w AS (PARTITION BY user_id, device ORDER BY ts, seq)
)
SELECT user_id, device, ts, seq,
       coalesce(base, device = 'desktop') <> ((total - coalesce(base_total, 0)) % 2 = 1) AS is_open
FROM b"""

_FLAT_MENUS = """
WITH items AS (
  SELECT page_id, 0 AS menu_pos, 'Navigation' AS menu,
         unnest(range(len(hrefs))) AS item_pos, unnest(hrefs) AS item_title,
         unnest(hrefs) AS item_href, NULL::VARCHAR[] AS subs
  FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs FROM pages)
  UNION ALL
  SELECT page_id, 1, 'Article', item_pos, item_title, '#',
         regexp_extract_all(item_title, '[^. ]+[.]')
  FROM (
    SELECT page_id, unnest(range(len(ps))) AS item_pos, unnest(ps) AS item_title
    FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS ps FROM pages)
  )
)
SELECT page_id, menu_pos, menu, CAST(item_pos AS INTEGER) AS item_pos, item_title, item_href,
       CAST(sub_pos AS INTEGER) AS sub_pos, sub_title, '#' || sub_title AS sub_href
FROM (
  SELECT * EXCLUDE (subs), unnest(range(len(subs))) AS sub_pos, unnest(subs) AS sub_title
  FROM items WHERE len(subs) > 0
  UNION ALL
  SELECT * EXCLUDE (subs), NULL, NULL FROM items WHERE subs IS NULL OR len(subs) = 0
)"""

_SUPPLIER_MENUS = """
SELECT s.s_suppkey // 64 AS block, r_name AS menu, n_name AS item_title,
       CAST(row_number() OVER (PARTITION BY n_nationkey, s.s_suppkey // 64 ORDER BY s.s_suppkey) - 1
            AS INTEGER) * CASE WHEN s.s_suppkey IS NULL THEN NULL ELSE 1 END AS sub_pos,
       s.s_suppkey AS sub_s_suppkey, s.s_name AS sub_s_name
FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN supplier s ON s_nationkey = n_nationkey"""

_CONFIG = """
config(series, label) AS (
  VALUES ('click', 'Clicks'), ('view', 'Views'), ('signup', ''), ('7', 'Seven'),
         ('42', 'Forty-two'), ('k', 'Other k'), ('value', 'Value')
)"""

_ITEMS = """
items AS (
  SELECT event_id, event_type,
         CASE WHEN value > 20 THEN 'k' WHEN value > 5 THEN 'event_type' ELSE '' END AS name_key,
         json_extract_string(props, '$.k') AS k
  FROM events
)"""

_EVENT_LABELS = f"""
WITH {_CONFIG}, {_ITEMS},
keyed AS (
  SELECT *, coalesce(nullif(name_key, ''), 'value') AS key,
         CASE name_key WHEN 'k' THEN k WHEN 'event_type' THEN event_type ELSE 'value' END AS named
  FROM items
)
SELECT event_id,
       coalesce(nullif(CASE WHEN a.series IS NOT NULL THEN a.label ELSE b.label END, ''), event_type)
         AS label
FROM keyed LEFT JOIN config a ON a.series = named LEFT JOIN config b ON b.series = key"""

_EVENT_LEGENDS = f"""
WITH {_CONFIG}, {_ITEMS},
keyed AS (
  SELECT *, coalesce(nullif(name_key, ''), event_type) AS key,
         CASE coalesce(nullif(name_key, ''), event_type)
           WHEN 'k' THEN k WHEN 'event_type' THEN event_type
           ELSE coalesce(nullif(name_key, ''), event_type) END AS named
  FROM items
)
SELECT event_id, key AS series, CASE WHEN a.series IS NOT NULL THEN a.label ELSE b.label END AS label
FROM keyed LEFT JOIN config a ON a.series = named LEFT JOIN config b ON b.series = key"""

_EVENT_TITLES = f"""
WITH {_CONFIG}, {_ITEMS},
keyed AS (
  SELECT *, name_key = 'k' AS has_key, CASE WHEN name_key = 'k' THEN 'k' ELSE 'event_type' END AS key,
         CASE WHEN name_key = 'k' THEN k ELSE event_type END AS named
  FROM items
)
SELECT event_id,
       CASE WHEN NOT has_key AND event_type <> 'error' THEN coalesce(nullif(t.label, ''), event_type)
            ELSE nullif(CASE WHEN a.series IS NOT NULL THEN a.label ELSE b.label END, '') END AS title
FROM keyed LEFT JOIN config a ON a.series = named LEFT JOIN config b ON b.series = key
LEFT JOIN config t ON t.series = event_type"""

_COLOURED = """
coloured AS (
  SELECT l_orderkey AS chart, l_linenumber AS pos, 'p' || l_partkey AS series, v.pos AS variant_pos,
         v.variant,
         CASE WHEN l_linestatus = 'O' AND v.variant = 'light' THEN '#l'
              WHEN l_linestatus = 'O' AND l_tax > 0.04 THEN '#d'
              WHEN l_returnflag = 'R' THEN '#r' END AS colour
  FROM lineitem, (VALUES (0, 'light'), (1, 'dark')) v(pos, variant)
  WHERE l_linestatus = 'O' OR l_returnflag = 'R'
)"""

_LINE = "'  --color-' || series || ': ' || colour || ';'"

_MEASURES = """
SELECT l_orderkey, l_linenumber, name, CASE name WHEN 'l_quantity' THEN 'Quantity'
         WHEN 'l_extendedprice' THEN 'Price' ELSE name END AS label,
       CASE WHEN value IS NULL THEN NULL
            ELSE rtrim(rtrim(format('{:,.3f}', value), '0'), '.') END AS text
FROM (
  SELECT l_orderkey, l_linenumber, 'l_quantity' AS name, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', CASE WHEN l_returnflag <> 'R' THEN l_tax END
  FROM lineitem
)"""

_PATHS = """
paths AS (
  SELECT page_id, CASE WHEN path = '' THEN '/' ELSE path END AS path
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
)"""

_UNROUTED = f"""
WITH {_PATHS}
SELECT path, count(*) AS n_accesses FROM paths WHERE path NOT LIKE '/en/%' GROUP BY path"""

_DAY_CLICKS = """
SELECT user_id, min(ts) AS dismissed_at, min(ts) + INTERVAL 1000 SECOND AS expires_at
FROM events WHERE event_type = 'click' GROUP BY user_id"""

SQL = {
    "replay_limit_1": _REPLAY_1,
    "replay_limit_1_cut": _REPLAY_1,
    "replay_limit_3": _REPLAY_3,
    "replay_limit_3_cut": _REPLAY_3,
    "replay_as_stream": _STREAM_FATES,
    "replay_limit_3_as_stream": f"""
SELECT * FROM ({_REPLAY_3})
WHERE removed_at <= (SELECT date_trunc('millisecond', max(ts) - INTERVAL 8 DAY) FROM events)""",
    "replay_in_batches": f"""
SELECT user_id, id, added_at, removed_at, cause FROM ({_REPLAY_1})
-- Actions at the watermark, the newest time, still wait.
WHERE removed_at < (SELECT max(ts) FROM events)
   OR (removed_at = (SELECT max(ts) FROM events) AND cause = 'expiry')""",
    "fan_out_twice": f"""
SELECT sink, cause, count(*) AS n_rows, count(DISTINCT id) AS n_ids
FROM ({_STREAM_FATES}), (VALUES ('first'), ('second')) s(sink) GROUP BY sink, cause""",
    "latest_event": """
SELECT ts, user_id, event_type, value, props, event_id AS seq FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "latest_three": """
SELECT ts, user_id, event_type, value, props, event_id AS seq,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS pos
FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3""",
    "running_value": """
SELECT user_id, ts, event_id AS seq,
       last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_viewed
FROM events""",
    "merged_profiles": """
WITH base AS (SELECT user_id, min(ts) AS since FROM events WHERE event_type = 'signup' GROUP BY user_id),
last AS (
  SELECT user_id, event_type, value, props FROM events WHERE event_type IN ('view', 'purchase')
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
)
SELECT b.user_id, b.since,
       CASE WHEN v.user_id IS NULL THEN 'new' WHEN v.value >= 5 THEN v.props END AS note,
       coalesce(p.value, -1.0) AS spent
FROM base b
LEFT JOIN last v ON v.user_id = b.user_id AND v.event_type = 'view'
LEFT JOIN last p ON p.user_id = b.user_id AND p.event_type = 'purchase'""",
    "dismissed_rows": f"""
WITH {_EV}
SELECT a.user_id, CAST(a.seq AS VARCHAR) AS id, a.ts, a.seq,
       NOT EXISTS (
         SELECT 1 FROM ev d WHERE d.user_id = a.user_id AND (d.ts > a.ts OR (d.ts = a.ts AND d.seq > a.seq))
           AND (d.event_type = 'error' OR (d.event_type = 'click' AND d.newest = a.seq))
       ) AS open
FROM ev a WHERE a.event_type = 'signup'""",
    "remaining_rows": f"""
WITH {_EV}
SELECT a.user_id, CAST(a.seq AS VARCHAR) AS id, a.ts, a.seq, TRUE AS open
FROM ev a WHERE a.event_type = 'signup' AND NOT EXISTS (
  SELECT 1 FROM ev d WHERE d.user_id = a.user_id AND (d.ts > a.ts OR (d.ts = a.ts AND d.seq > a.seq))
    AND (d.event_type = 'error' OR (d.event_type = 'purchase' AND d.newest = a.seq))
)""",
    "expiry_times": _DAY_CLICKS,
    "numbered_events": """
SELECT event_id AS seq, CAST(row_number() OVER (ORDER BY ts, event_id) AS VARCHAR) AS id FROM events""",
    # A week's rows come before those of the next, so the ids are those of one batch.
    "numbered_as_stream": """
SELECT event_id AS seq, CAST(row_number() OVER (ORDER BY ts, event_id) AS VARCHAR) AS id FROM events""",
    "snapshots_of_removals": f"""
SELECT cause, count(*) AS n_rows, count(*) AS n_counted FROM ({_STREAM_FATES}) GROUP BY cause""",
    "unrouted_windows_as_stream": f"""
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end,
       '/' || event_type || '/' || (user_id % 20) AS path, count(*) AS n_accesses
FROM events
WHERE event_type <> 'view' AND NOT (event_type = 'click' AND user_id % 20 < 9)
  AND date_trunc('day', ts) + INTERVAL 1 DAY <= {_SEEN}
GROUP BY ALL""",
    "hourly_sessions": _SESSIONS.format(gap=1),
    "hourly_sessions_cut": _SESSIONS.format(gap=1),
    "sessions_as_stream": f"""
SELECT * FROM ({_SESSIONS.format(gap=6)})
WHERE session_end + INTERVAL 6 HOUR - INTERVAL 1 MICROSECOND <= {_SEEN}""",
    "menu_intervals": _MENUS,
    "menu_intervals_cut": _MENUS,
    "menu_intervals_as_stream": f"""
SELECT * FROM ({_MENUS}) WHERE closed_at <= {_SEEN_OF.format("<> 'purchase'")}""",
    "threshold_changes": _CHANGES,
    "threshold_changes_cut": _CHANGES,
    "threshold_changes_as_stream": f"SELECT * FROM ({_CHANGES}) WHERE ts <= {_SEEN}",
    "panel_state": _PANELS,
    "panel_state_cut": _PANELS,
    "panel_state_as_stream": f"""
SELECT * FROM ({_PANELS}) WHERE ts <= {_SEEN_OF.format("IN ('click', 'error')")}""",
    "panel_cookies": f"""
SELECT user_id, 'panel=' || CASE WHEN is_open THEN 'true' ELSE 'false' END
         || '; path=/; max-age=604800' AS cookie, ts + INTERVAL 7 DAY AS expires_at
FROM (
  SELECT * FROM ({_PANELS}) WHERE device = 'desktop' AND ts <= (SELECT max(ts) FROM events)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) = 1
) WHERE ts + INTERVAL 7 DAY > (SELECT max(ts) FROM events)""",
    "unexpired_values": """
SELECT user_id, event_type, value, ts AS written_at, ts + INTERVAL 7 DAY AS expires_at FROM (
  SELECT * FROM events WHERE ts <= (SELECT max(ts) FROM events)
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
) WHERE ts + INTERVAL 7 DAY > (SELECT max(ts) FROM events)""",
    "values_with_ttl_as_stream": f"""
WITH w AS (
  SELECT user_id, event_type, props AS value, ts AS written_at, ts + INTERVAL 2 DAY AS expires_at,
         lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next_at
  FROM events
)
SELECT user_id, event_type, value, written_at, expires_at, TRUE AS live FROM w WHERE next_at IS NULL
UNION ALL
SELECT user_id, event_type, value, written_at, expires_at, FALSE FROM w
WHERE next_at >= expires_at OR (next_at IS NULL AND expires_at <= {_SEEN})""",
    "flat_menus": _FLAT_MENUS,
    "supplier_menus": _SUPPLIER_MENUS,
    "returned_with_supplier": """
SELECT l_orderkey, l_linenumber, l_suppkey, s_name
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'""",
    "nations_with_suppliers": """
SELECT n_nationkey, n_name, n_regionkey FROM nation
WHERE n_regionkey > 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier)""",
    "priority_texts": """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
       CASE WHEN o_orderstatus = 'P' THEN 'plan' ELSE
         CASE o_orderpriority WHEN '1-URGENT' THEN 'act now' WHEN '2-HIGH' THEN 'act soon'
           WHEN '3-MEDIUM' THEN 'plan' WHEN '4-NOT SPECIFIED' THEN 'ask' END END AS priority_text,
       CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE 'open' END AS status_text
FROM orders""",
    "event_labels": _EVENT_LABELS,
    "event_legends": _EVENT_LEGENDS,
    "skeleton_widths": """
SELECT event_type, count(*) AS n_in_range, count(*) AS n_same, count(*) > 40 AS varied
FROM events GROUP BY event_type""",
    "event_titles": _EVENT_TITLES,
    "series_colours": f"""
WITH {_COLOURED}
SELECT chart, pos, series, variant, colour FROM coloured WHERE colour IS NOT NULL""",
    "colour_lines": f"""
WITH {_COLOURED}
SELECT chart, variant, string_agg(coalesce({_LINE}, ''), chr(10) ORDER BY pos, series, colour NULLS FIRST) AS with_empty,
       coalesce(string_agg({_LINE}, chr(10) ORDER BY pos, series, colour NULLS FIRST), '') AS dense
FROM coloured GROUP BY chart, variant""",
    "chart_styles": f"""
WITH {_COLOURED},
blocks AS (
  SELECT chart, variant_pos,
         chr(10) || CASE variant WHEN 'dark' THEN '.dark' ELSE '' END || ' [data-chart=' || chart
         || '] {{' || chr(10) || string_agg(coalesce({_LINE}, ''), chr(10) ORDER BY pos, series, colour NULLS FIRST)
         || chr(10) || '}}' || chr(10) AS block
  FROM coloured GROUP BY chart, variant_pos, variant
)
SELECT chart, string_agg(block, chr(10) ORDER BY variant_pos) AS style FROM blocks GROUP BY chart""",
    "measure_rows": _MEASURES,
    "measure_rows_with_unit": """
SELECT o_orderkey, 'o_totalprice' AS label,
       rtrim(rtrim(format('{:,.3f}', o_totalprice), '0'), '.') || ' of o_totalprice #0' AS text
FROM orders""",
    "page_routes": f"""
WITH {_PATHS}
SELECT page_id, path, CASE WHEN path LIKE '/en/%' THEN path ELSE '*' END AS route FROM paths""",
    "unrouted_accesses": _UNROUTED,
    "unrouted_accesses_as_stream": _UNROUTED,
    "dead_page_links": f"""
WITH {_PATHS},
links AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT href, count(*) AS n_links FROM links
WHERE href NOT IN (SELECT path FROM paths) GROUP BY href""",
    "dead_relative_links": f"""
WITH {_PATHS},
dirs AS (SELECT page_id, regexp_replace(path, '[^/]*$', '') AS dir FROM paths),
links AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">', 1)) AS name FROM pages
),
resolved AS (
  SELECT CASE page_id % 5 WHEN 0 THEN '/' WHEN 1 THEN dir WHEN 3 THEN dir
           WHEN 2 THEN CASE WHEN dir = '/' THEN dir ELSE regexp_replace(dir, '[^/]*/$', '') END END || name AS href
  FROM links JOIN dirs USING (page_id)
)
SELECT href, count(*) AS n_links FROM resolved
WHERE href IS NOT NULL AND href NOT IN (SELECT path FROM paths) GROUP BY href""",
    "scalar_values": """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'outline' ELSE 'default' END AS variant,
       CAST(floor(value * 10) AS INTEGER) < 768 AS is_mobile,
       CASE WHEN value > 20 THEN 'expanded' ELSE 'collapsed' END AS panel,
       substr(event_type, 4, 1) = 'b' AND (value > 50 OR event_type = 'error') AS shortcut,
       event_type IN ('click', 'view') AS pointer,
       value > 30 OR event_type <> 'error' AS styled,
       replace(props, ':', '') AS stripped,
       'panel=' || CASE WHEN value > 20 THEN 'true' ELSE 'false' END || '; path=/; max-age=604800' AS cookie,
       CASE WHEN value = 0 THEN '0'
            ELSE rtrim(rtrim(format('{:,.3f}', value * 1000), '0'), '.') END AS formatted,
       CAST(100 - CASE WHEN value <= 100 THEN floor(value) ELSE 0 END AS BIGINT) AS remaining,
       CAST(event_id AS VARCHAR) AS text_id,
       CASE WHEN event_type = 'click' THEN CASE WHEN value > 9 THEN event_type ELSE 'value' END
            WHEN value > 9 THEN event_type ELSE 'value' END AS key,
       event_type <> 'view' AS is_empty
FROM events""",
}
