"""Text rules: normalisation, control prefixes, prompts, URIs and small formatters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.fields import strip

# Chinese characters and the punctuation that takes no spaces beside them.
CJK = "㐀-䶿一-鿿豈-﫿"
CJK_MARKS = "，。！？；：、（）《》「」『』“”‘’—…·"
#: Leading control marks of a recogniser's output: tags, '<|..|>' and 'language <Name>[_suffix]'.
CONTROL_PREFIX = r"(?U)^(?:[\s\x1C-\x1F]*(?:<asr_text>|(?i:language[\s\x1C-\x1F]+(?:chinese|english|german|french)(?:_[a-z_]*)?(?![a-z_]))|<\|[^>]+\|>))*[\s\x1C-\x1F]*"
# Status codes and message parts of errors worth another attempt.
RETRY_STATUS = (429, 500, 502, 503, 504)
RETRY_TYPES = ("ConnectionError", "ConnectionResetError", "ConnectionRefusedError", "ConnectionAbortedError", "BrokenPipeError", "TimeoutError")
RETRY_PARTS = "partitionqpslimitted|partition qps limitted|please retry later|too many requests|temporarily unavailable|timeout|connection|reset|refused|broken pipe|network|errno"


def squeezed(value: Column) -> Column:
    """Ideographic and other white space made single ordinary spaces, none at the ends."""
    return strip(F.regexp_replace(value, r"(?U)\s+", " "))


_BESIDE_CJK = re.compile(rf"(?<=[{CJK}{CJK_MARKS}])\s+(?=[{CJK}{CJK_MARKS}])")


def normalized_text(text: str, lang: str) -> str:
    """NFKC, white space squeezed, and for Chinese no spaces between Chinese characters or punctuation."""
    plain = " ".join(unicodedata.normalize("NFKC", text).split())
    return _BESIDE_CJK.sub("", plain) if lang == "zh" else plain


@F.pandas_udf(T.StringType())
def _normalized(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, langs in parts:
        yield pd.Series([normalized_text(t, l) if isinstance(t, str) else None for t, l in zip(texts, langs)])


def normalized(text: Column, code: Column) -> Column:
    """`normalized_text` of a supported language, else null; ASCII text never leaves the JVM. Nothing left gives null."""
    ascii_only = text.rlike(r"^[\x00-\x7F]*$")
    other = _normalized(F.when(~ascii_only, text), F.coalesce(code, F.lit("")))
    return F.when(code.isin("zh", "en", "de", "fr"), F.nullif(F.when(ascii_only, squeezed(text)).otherwise(other), F.lit("")))


def without_control_prefix(value: Column) -> Column:
    return F.regexp_replace(value, CONTROL_PREFIX, "")


def uri_part(uri: Column, part: int) -> Column:
    """Bucket (1) or key (2) of an object URI, null where either is missing."""
    found = F.regexp_extract(uri, r"^oss://([^/]+)/(.+)$", part)
    return F.nullif(found, F.lit(""))


def cache_path(uri: Column, root: str) -> Column:
    """Where an object is kept locally; null for other references."""
    return F.when(uri_part(uri, 1).isNotNull(), F.concat_ws("/", F.lit(root), uri_part(uri, 1), uri_part(uri, 2)))


def side_index_path(path: Column, kind: str) -> Column:
    """A manifest's side index: the '.jsonl' ending replaced, or the kind appended."""
    return F.when(path.endswith(".jsonl"), F.concat(F.substring(path, F.lit(1), F.length(path) - 6), F.lit(f".{kind}.npy"))).otherwise(F.concat(path, F.lit(f".{kind}.npy")))


def retryable(status: Column, error_type: Column, message: Column, code: Column | None = None) -> Column:
    """Whether a failed request is worth another attempt, by its status, type, or error code and message."""
    said = F.lower(F.concat_ws(" ", *(x for x in (code, message) if x is not None)))
    return F.coalesce(status.isin(*RETRY_STATUS), F.lit(False)) | F.coalesce(error_type.isin(*RETRY_TYPES), F.lit(False)) | said.rlike(RETRY_PARTS)


def parameter_count(n: Column) -> Column:
    """A count as 1.23B, 4.56M, 7.89K or itself, rounded as the binary value is."""
    shown = lambda unit, letter: F.concat(F.call_function("format_number", n / unit, F.lit("0.00")), F.lit(letter))
    return F.when(n >= 10**9, shown(1e9, "B")).when(n >= 10**6, shown(1e6, "M")).when(n >= 10**3, shown(1e3, "K")).otherwise(n.cast("string"))
