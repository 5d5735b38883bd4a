"""SQL names for the engine's functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from folioground.functions import text as X
from folioground.operators.chunking import register_chunk_text


def register_all(spark: SparkSession) -> None:
    """``normalize_nfkc(text)``, ``normalize_text(text)``, ``vector_norm(a)``, ``cosine(a, b)`` and the table function ``chunk_text``."""
    spark.udf.register("normalize_nfkc", X._nfkc)
    spark.sql(f"""
create or replace temporary function normalize_text(t string) returns string return
 coalesce(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(normalize_nfkc(case when octet_length(t) <> length(t) then t end), t)), r'{X.NOT_SEARCHED}', ' '), r'{X.WS}+', ' '), r'^{X.WS}+|{X.WS}+$', ''), '')""")
    spark.sql("""
create or replace temporary function vector_norm(a array<double>) returns double return sqrt(aggregate(a, 0d, (s, x) -> s + x * x))""")
    # Each norm is taken once: the lambda's argument holds both.
    spark.sql("""
create or replace temporary function cosine(a array<double>, b array<double>) returns double return
 case when size(a) > 0 and size(a) = size(b) then
  transform(array(struct(vector_norm(a) as x, vector_norm(b) as y, aggregate(zip_with(a, b, (x, y) -> x * y), 0d, (s, x) -> s + x) as p)),
   n -> case when n.x > 0 and n.y > 0 then least(1d, greatest(0d, n.p / n.x / n.y)) else 0d end)[0] else 0d end""")
    register_chunk_text(spark)
