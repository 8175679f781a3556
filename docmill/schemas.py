"""Fixed schemas of the tables that the engine passes around."""

from pyspark.sql import types as T


def _of(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampNTZType(), "x": T.BinaryType(), "a": T.ArrayType(T.StringType()), "m": T.MapType(T.StringType(), T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, _, k in (f.partition(":") for f in spec.split())])


DOC = _of("company:s title:s link:s snippet:s date:t source:s full_text:s source_file:s")
SEARCH_RESULT = _of("url:s title:s snippet:s search_rank:i query:s")
FETCH_RESULT = _of("url:s status:i html:s content_type:s content_bytes:x error:s response_headers:m")
TRANSCRIPT_INFO = _of("url:s ticker:s quarter:s year:i pub_date:s")
FUTURES_CONTRACT = _of("exchange:s product_name:s ticker:s asset_class:s contract_size:s quote_currency:s tick_size:s trading_months:s settlement_type:s trading_hours:s last_trade_date_rule:s source_url:s extra_specs:m error:s scraped_at:s")
PROVENANCE = _of("link:s source_parquet:s")
EMPTY_DOC_VALUES = {c: "" for c in DOC.fieldNames() if c != "date"}
