"""Fields of a manifest record as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field aliases in priority order.
DURATION_FIELDS = "duration_sec duration audio_duration_sec wav_duration".split()
AUDIO_FIELDS = "audio_path wav_path audio_local_path local_audio_path path".split()
TEXT_FIELDS = "text_norm text gold_text".split()
# Display names of the languages of the tagged target format.
LANGUAGE_NAMES = {"zh": "Chinese", "en": "English", "de": "German", "fr": "French"}
# Dataset keys that say their language.
LANGUAGE_DATASETS = {
    "zh": ("AISHELL-1_Chinese", "CommonVoice_Chinese", "kespeech", "acgn_zh", "ZHvoice_Chinese", "Emilia-YODAS_Chinese"),
    "en": ("CommonVoice_English", "Emilia-YODAS_English", "acgn_en", "gigaspeech_en"),
}
#: A decimal number as Python and both SQL engines read it.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
IGNORED_LABEL = -100
SAMPLE_RATE = 16000


def strip(value: Column) -> Column:
    """Without leading and trailing white space in the Unicode sense."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def nonblank(value: Column) -> Column:
    """The stripped value, or null where nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def dataset_key(value: Column) -> Column:
    """A dataset key without padding and letter case; null for a blank one, for which the file's key stands."""
    return nonblank(F.lower(value))


def positive_number(value: Column) -> Column:
    """A string's value if it is a finite number above 0, else null."""
    text = strip(value.cast("string"))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when((number > 0) & (number < F.lit(float("inf"))) & ~F.isnan(number), number)


def first_duration(values: Sequence[Column]) -> Column:
    """The first usable duration in seconds of the aliases; null when none is."""
    return F.coalesce(*map(positive_number, values))


def length_proxy(duration: Column, token_len: Column, token_ids: Column) -> Column:
    """Duration, else a positive token count, else the number of token ids, else 0."""
    count = F.when(strip(token_len).rlike(r"^[+-]?\d+$"), strip(token_len).try_cast("long"))
    return F.coalesce(duration, F.when(count > 0, count).cast("double"), F.when(token_ids.isNotNull(), F.size(token_ids)).cast("double"), F.lit(0.0))


def truthy_text(values: Sequence[Column]) -> Column:
    """The first value that isn't null or empty, stripped: a blank one wins and strips to ''."""
    return strip(F.coalesce(*(F.nullif(v, F.lit("")) for v in values)))


def language_code(lang: Column) -> Column:
    return F.lower(strip(lang))


def inferred_language(key: Column) -> Column:
    """The language of a dataset whose key says it; null for any other key."""
    known = [(k, code) for code, keys in LANGUAGE_DATASETS.items() for k in keys]
    return F.create_map(*(F.lit(x) for pair in known for x in pair))[key]


def resolved_dtype(name: Column, on_gpu: Column, has_bfloat16: Column) -> Column:
    """The number type a model is loaded with, from a configured name; an unknown name is an error.

    Half-size types exist on a GPU only. 'auto' and no name take bfloat16 where there is hardware for it.
    """
    plain = F.coalesce(F.lower(strip(name)), F.lit(""))
    half = F.when(has_bfloat16, "bfloat16").otherwise("float16")
    wanted = (
        F.when(plain.isin("", "auto"), half).when(plain.isin("bf16", "bfloat16"), "bfloat16").when(plain.isin("fp16", "float16", "half"), "float16").when(plain.isin("fp32", "float32"), "float32")
    )
    return F.when(wanted.isNull(), F.raise_error(F.concat(F.lit("unknown number type "), plain))).when(on_gpu, wanted).otherwise("float32")


def mixed_precision_dtype(name: Column, on_gpu: Column, has_bfloat16: Column) -> Column:
    """The number type of mixed precision; null where it is off: by name, for float32, and without a GPU."""
    plain = F.coalesce(F.lower(strip(name)), F.lit(""))
    off = plain.isin("", "false", "none", "off", "0") | ~on_gpu | plain.isin("fp32", "float32")
    half = F.when(has_bfloat16, "bfloat16").otherwise("float16")
    wanted = F.when(plain.isin("true", "auto", "bf16", "bfloat16"), half).when(plain.isin("fp16", "float16", "half"), "float16")
    return F.when(~off, F.coalesce(wanted, F.raise_error(F.concat(F.lit("unknown number type "), plain))))


def used_temperature(do_sample: Column, temperature: Column) -> Column:
    """The temperature that stays in a generation configuration: without sampling only the neutral 1.0."""
    return F.when(F.coalesce(do_sample, F.lit(False)) | (temperature == 1.0), temperature)


def language_name(code: Column) -> Column:
    """Display name of a supported code, else null."""
    return F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))[code]


def target_text(explicit: Column, texts: Sequence[Column], lang: Column, form: str = "qwen_asr") -> Column:
    """The explicit target if not blank, else the text in the named form; null for an unsupported language."""
    source = F.coalesce(truthy_text(texts), F.lit(""))
    name = form.strip().lower()
    if name == "plain_text":
        built = source
    elif name == "qwen_asr":
        built = F.concat(F.lit("language "), language_name(language_code(lang)), F.lit("<asr_text>"), source)
    else:
        raise ValueError(f"unknown target format {form!r}")
    return F.coalesce(nonblank(explicit), built)


def over_cap(duration: Column, cap: float) -> Column:
    """Whether a known duration exceeds the cap; never null, false for unknown ones and a cap of 0 or less."""
    if cap <= 0:
        return F.lit(False)
    return F.coalesce(duration > cap, F.lit(False))


def length_bin(length: Column, edges: Sequence[int]) -> Column:
    """Number of the first right-closed bin that holds the truncated length."""
    whole = length.cast("long")
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < whole)).cast("long")


def origin(path: Column, line: Column) -> Column:
    """'path:line', 'path', 'line=N' or '' from what is known."""
    known = F.nullif(path, F.lit(""))
    at = line.cast("string")
    return F.when(known.isNotNull() & at.isNotNull(), F.concat(known, F.lit(":"), at)).when(known.isNotNull(), known).when(at.isNotNull(), F.concat(F.lit("line="), at)).otherwise("")


def masked_labels(ids: Column, audio_id: int, eos_id: int) -> Column:
    """Ids with the end mark appended and audio placeholders hidden from the loss."""
    return F.transform(F.concat(ids, F.array(F.lit(eos_id).cast("long"))), lambda x: F.when(x == audio_id, F.lit(IGNORED_LABEL).cast("long")).otherwise(x))
