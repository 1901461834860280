from siteops.sources.session import prepare_streams
from siteops.sources.tables import SCHEMAS, read_if_there, read_table, with_utc_time
from siteops.sources.streams import stream_table

__all__ = ["SCHEMAS", "prepare_streams", "read_if_there", "read_table", "stream_table", "with_utc_time"]
