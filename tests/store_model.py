"""The notification store as a plain loop, for comparison only."""


def run(actions, k, delay, fields=()):
    """actions: (ts, seq, kind, id, patch) of one store. Returns id -> fate."""
    stored, timers, fates, issued = [], {}, {}, set()

    def gone(row, t, cause):
        fates[row["id"]].update(removed_at=t, cause=cause, open=row["open"], **snap(row))
        stored.remove(row)

    def snap(row):
        return {f: row["patch"].get(f) for f in fields}

    def fire(upto):
        for rid, due in sorted(timers.items(), key=lambda x: x[1]):
            if upto is None or due <= upto:
                del timers[rid]
                for row in [r for r in stored if r["id"] == rid]:
                    gone(row, due, "expiry")

    for t, _, kind, rid, patch in sorted(actions, key=lambda a: a[:2]):
        fire(t)
        if rid == "":
            continue
        if kind == "ADD":
            row = {"id": rid, "open": True, "patch": dict(patch or {})}
            issued.add(rid)
            fates[rid] = {"added_at": t, "removed_at": None, "cause": None}
            stored.insert(0, row)
            for old in stored[k:]:
                gone(old, t, "evict")
        elif kind == "UPDATE":
            for row in stored:
                if row["id"] == rid:
                    row["patch"].update(patch or {})
                    if "open" in (patch or {}):
                        value = patch["open"]
                        row["open"] = None if value is None else value == "true"
        elif kind == "DISMISS":
            for row in stored:
                if rid is None or row["id"] == rid:
                    row["open"] = False
                    timers.setdefault(row["id"], t + delay)
        elif kind == "REMOVE":
            for row in list(stored):
                if rid is None or row["id"] == rid:
                    gone(row, t, "remove")
    fire(None)
    for row in stored:
        fates[row["id"]].update(open=row["open"], **snap(row))
    return fates
