"""Captured pages: schema, reading, and extraction of signals and content from HTML."""

from __future__ import annotations

import codecs
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, MapType, StringType

from quarry.functions.html import SIGNALS, parse_page
from quarry.functions.text import _evidence_of, evidence
from quarry.functions.urls import normalize_url, origin, redact_reference, redact_text
from quarry.operators.shared import cut

CONTENT = "struct<characters:int,words:int,sha256:string,simhash:bigint>"
HOP = "struct<url:string,status:int,location:string,duration_ms:double>"
STATES = ("complete", "timeout", "network-error", "max-bytes-exceeded", "robots-blocked", "invalid-response")
#: One capture per address and agent.
CAPTURE = f"url string, agent string, agent_ord int, completion string, status int, final_url string, content_type string, redirects array<{HOP}>, signals {SIGNALS}, content {CONTENT}, duration_ms double, error string"


def content_of(text) -> F.Column:
    return evidence(text)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as complete captures: one pass, one parse per page, with the fingerprints of its visible text.

    The pass is a stage of its own, so no filter on a result runs the parser again. Rules read the extracted columns; html is read here alone.
    """
    types = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    signals_type, content_type = (to_arrow_type(DataType.fromDDL(t)) for t in (SIGNALS, CONTENT))

    def run(batches):
        for b in batches:
            seen = [parse_page(h, u) for h, u in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            facts = [dict(zip(("characters", "words", "sha256", "simhash"), _evidence_of(s["content_text"]), strict=True)) for s in seen]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(seen, signals_type), pa.array(facts, content_type)], ["page_id", "url", "signals", "content"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"{types}, signals {SIGNALS}, content {CONTENT}")


#: Header names that hide their value, and those that hold addresses.
SENSITIVE_HEADER = r"(?i)(?:^|[-_])(?:authorization|cookie|credential|api[-_]?key|secret|session|token)(?:$|[-_])"
ADDRESS_HEADERS = ("content-location", "link", "location", "refresh")


def safe_header(name: str, value: str | None) -> str | None:
    """A header's value without secrets: hidden whole, or with the addresses in it redacted."""
    if value is None:
        return None
    if re.search(SENSITIVE_HEADER, name):
        return "[redacted]"
    kind = name.lower()
    if kind in ("location", "content-location"):
        return redact_reference(value)
    if kind == "link":
        return redact_text(re.sub(r"<([^>]+)>", lambda m: f"<{redact_reference(m[1])}>", value))
    if kind == "refresh":

        def target(m: re.Match) -> str:
            quote = m[2][0] if m[2][0] in "\"'" else ""
            return m[1] + quote + redact_reference(m[2][1:-1] if quote else m[2].strip()) + quote

        return redact_text(re.sub(r"(url\s*=\s*)([^;]+)", target, value, count=1, flags=re.I))
    return value


@F.pandas_udf(MapType(StringType(), StringType()))
def _safe_headers(headers: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else {k: safe_header(k, v) for k, v in (h.items() if isinstance(h, dict) else h)} for h in headers])


def sanitized_headers(headers) -> F.Column:
    """Values of credential headers hidden, addresses in the four address headers redacted."""
    plain = F.transform_values(headers, lambda k, v: F.when(k.rlike(SENSITIVE_HEADER), F.lit("[redacted]")).otherwise(v))
    held = F.exists(F.map_keys(headers), lambda k: F.lower(k).isin(*ADDRESS_HEADERS))
    return F.when(held, _safe_headers(F.when(held, headers))).otherwise(plain)


def body_prefix(content, limit: int) -> F.Column:
    """struct<content, bytes_read, sha256, exceeded>: at most `limit` bytes of a body, and the digest of what is kept."""
    kept = F.substring(F.coalesce(content, F.lit(b"")), 1, limit)
    return F.struct(kept.alias("content"), F.octet_length(kept).alias("bytes_read"), F.sha2(kept, 256).alias("sha256"), (F.octet_length(F.coalesce(content, F.lit(b""))) > limit).alias("exceeded"))


def charset(content_type) -> F.Column:
    """The charset that a content type names, utf-8 where it names none."""
    named = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([^;\s\"']+)", 1))
    return F.when(named == "", "utf-8").otherwise(named)


@F.pandas_udf(StringType())
def _decoded(content: pd.Series, name: pd.Series) -> pd.Series:
    def one(raw, label):
        if raw is None:
            return None
        # The web reads these labels as Windows' Latin code page.
        label = "cp1252" if label in ("iso-8859-1", "latin1", "us-ascii", "ascii") else label
        try:
            codecs.lookup(label)
        except LookupError:
            label = "utf-8"
        return bytes(raw).decode("utf-8-sig" if label.replace("_", "-") in ("utf-8", "utf8") else label, "replace")

    return pd.Series([one(c, n) for c, n in zip(content, name, strict=True)], dtype=object)


def decoded(content, content_type) -> F.Column:
    """A body as text by its content type; unknown charsets count as utf-8. Valid UTF-8 stays in the JVM's own functions."""
    name = charset(content_type)
    plain = name.isin("utf-8", "utf8") & F.is_valid_utf8(content.cast("string"))
    text = F.regexp_replace(content.cast("string"), "^\\x{FEFF}", "")
    return F.when(plain, text).otherwise(_decoded(F.when(~plain, content), name))


MOVED = (301, 302, 303, 307, 308)


def follow_redirects(requests: DataFrame, responses: DataFrame, most: int = 5, header_origin: str | None = None) -> DataFrame:
    """The redirect chains of requests(url) over recorded responses(url, status, location, duration_ms).

    url, final_url, status, redirects (hops), completion, error, headers_sent: how many of its requests stayed on header_origin, the only ones
    that may carry configured headers. At most most + 1 rounds, each one join on the address; hops over the limit are kept, with the
    completion invalid-response. A response that was not recorded is a network-error.
    """
    r = responses.select(F.col("url").alias("at"), F.col("status").alias("s"), "location", "duration_ms", F.lit(True).alias("known"))
    empty = F.array().cast(f"array<{HOP}>")
    none = F.lit(None).cast("string")
    open_ = requests.select("url", F.col("url").alias("at"), empty.alias("redirects"), F.lit(0).alias("headers_sent"))
    ended = None
    for k in range(most + 1):
        step = open_.join(r, "at", "left").withColumn("headers_sent", F.col("headers_sent") + F.coalesce((origin(F.col("at")) == F.lit(header_origin)).cast("int"), F.lit(0)))
        step = step.withColumn("next", F.when(F.col("s").isin(*MOVED), normalize_url(F.col("location"), F.col("at"))))
        hop = F.struct(F.col("at").alias("url"), F.col("s").cast("int").alias("status"), F.col("next").alias("location"), F.col("duration_ms").cast("double").alias("duration_ms"))
        step = step.withColumn("redirects", F.when(F.col("next").isNotNull(), F.concat("redirects", F.array(hop))).otherwise(F.col("redirects")))
        step = cut(step)
        over = F.size("redirects") > most
        done = step.where(F.col("next").isNull() | over)
        moved = F.coalesce(F.col("s").isin(*MOVED), F.lit(False))
        error = F.when(F.col("known").isNull(), "no response").when(F.col("next").isNotNull(), "redirect limit exceeded").when(moved & F.col("location").isNull(), "redirect without a location").when(moved, "redirect to an invalid location").otherwise(none)
        completion = F.when(F.col("known").isNull(), "network-error").when(moved, "invalid-response").otherwise("complete")
        part = done.select("url", F.col("at").alias("final_url"), F.col("s").cast("int").alias("status"), "redirects", completion.alias("completion"), error.alias("error"), "headers_sent")
        ended = part if ended is None else ended.union(part)
        open_ = step.where(F.col("next").isNotNull() & ~over).select("url", F.col("next").alias("at"), "redirects", "headers_sent")
        if open_.isEmpty():
            break
    return ended


def with_rendered(routes: DataFrame, rendered: DataFrame) -> DataFrame:
    """routes with the rendered capture (rendered: url, completion, status, signals, content) of the same address, null where there is none."""
    one = rendered.select(F.col("url").alias("__url"), F.struct("completion", "status", "signals", "content").alias("rendered"))
    return routes.drop("rendered").join(one, F.col("url") == F.col("__url"), "left").drop("__url")
