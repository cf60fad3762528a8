"""Probe events: JSON text to typed columns, batch or stream."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BODY = ("domain string, checkpoint string, isp string, region string, dns_ok string, tcp_ok string, http_ok string, keyword_ok string, "
         "status_code string, latency_ms string, ssl_days_left string")


def parse_probe_events(df: DataFrame, column: str = "value") -> DataFrame:
    """Probe JSON, optionally wrapped in ``body``.  Flags may be booleans or the text "true"; a missing region is TH; a probe is
    ok when all four layers are."""
    wrapped = F.from_json(F.get_json_object(column, "$.body"), _BODY)
    b = F.coalesce(wrapped, F.from_json(column, _BODY))
    t = df.withColumn("__b", b)
    flag = lambda c: F.coalesce(F.col(f"__b.{c}") == "true", F.lit(False))
    number = lambda c: F.col(f"__b.{c}").try_cast("double")
    out: dict[str, Column] = {c: F.col(f"__b.{c}") for c in ("domain", "checkpoint", "isp")}
    out["region"] = F.coalesce(F.col("__b.region"), F.lit("TH"))
    layers = ("dns_ok", "tcp_ok", "http_ok", "keyword_ok")
    out |= {c: flag(c) for c in layers}
    out |= {"status_code": F.coalesce(number("status_code"), F.lit(0)).cast("int"), "latency_ms": number("latency_ms"), "ssl_days_left": number("ssl_days_left").cast("int")}
    out["ok"] = flag("dns_ok") & flag("tcp_ok") & flag("http_ok") & flag("keyword_ok")
    return t.select(*[c for c in df.columns if c != column], *[v.alias(k) for k, v in out.items()])
