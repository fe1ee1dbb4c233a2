"""Quality rules from tokenizer fertility.

Public vocabularies are run over the words of each text. Characters per token, the share of
byte-fallback tokens and the entropy of the tokens are held against rejection bands of the
document's language, else of its main script. Plain text measures (length, symbols, repeated
lines and word windows) come with them, as a base rule that rejects before the bands do.

Defined results: a null or empty text has zero counts, no ratios (null) and fails the base
rule. Repeated rows and ids are measured row by row; null ids stay null. Only the columns
`doc_id`, `text` and, if present, `lang` are read, so other columns may have any name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .vocab import WordIds, default_path, piece_model, worker_words
from .words import Slice, mix, repeated, slices

REPEAT_WINDOW = 5


@dataclass(frozen=True)
class Band:
    """A text within all limits stays. `entropy` is a share of the most that its token count,
    up to `entropy_tokens`, allows; texts under `least_tokens` tokens are not judged by it.
    With `script`, the band holds for texts of that main script only."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float
    least_tokens: int = 32
    entropy_tokens: int = 256
    script: str | None = None


# Languages first, then scripts, then "other". Wide on purpose: they reject strings no writer
# makes (encoded data, broken decoding, one phrase over and over), not unusual prose.
# Where no piece is known, a letter is 3 or 4 byte tokens and a word has one more.
BANDS: dict[str, Band] = {
    **{lang: Band((1.25, 8.0), 0.25, 0.45, script="latin") for lang in ("de", "en", "es", "fr")},
    "vi": Band((0.8, 8.0), 0.4, 0.45, script="latin"),
    "latin": Band((1.25, 12.0), 0.25, 0.45),
    "greek": Band((0.7, 8.0), 0.5, 0.4),
    "cyrillic": Band((0.9, 10.0), 0.4, 0.45),
    "hebrew": Band((0.6, 6.0), 0.7, 0.4),
    "arabic": Band((0.6, 6.0), 0.7, 0.4),
    "indic": Band((0.2, 5.0), 1.0, 0.3),
    "cjk": Band((0.2, 3.0), 1.0, 0.4),
    "other": Band((0.15, 12.0), 1.0, 0.3),
}
_SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "cjk", "other")


_NAMED = {
    "latin": "LATIN FEMININE MASCULINE",
    "greek": "GREEK",
    "cyrillic": "CYRILLIC",
    "hebrew": "HEBREW",
    "arabic": "ARABIC",
    "indic": "DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM SINHALA THAI LAO TIBETAN",
    "cjk": "CJK HIRAGANA KATAKANA HANGUL BOPOMOFO YI",
}


@lru_cache(maxsize=1)
def _script_of_point() -> np.ndarray:
    """Script of each code point under 65,536 by its Unicode name; -1 for what is no letter
    or vowel sign, and for signs that any script uses."""
    scripts = {word: _SCRIPTS.index(name) for name, words in _NAMED.items() for word in words.split()}
    out = np.full(1 << 16, -1, np.int8)
    for point in range(1 << 16):
        if unicodedata.category(chr(point)) in {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc"}:
            words = unicodedata.name(chr(point), "MODIFIER").removeprefix("FULLWIDTH ").removeprefix("HALFWIDTH ").split()
            if words[0] in scripts:
                out[point] = scripts[words[0]]
            elif words[0] not in {"COMBINING", "MODIFIER", "VARIATION", "MICRO"} and not 0x2100 <= point < 0x2150:
                out[point] = _SCRIPTS.index("other")
    return out


def main_script(part: Slice) -> np.ndarray:
    """Index of the script with most letters; Latin where there is no letter."""
    data = part.data
    found = np.full(len(data), -1, np.int8)
    table = _script_of_point()
    plain = data < 0x80
    found[plain] = table[data[plain]]
    if plain.all():
        return np.zeros(len(part), np.int64)
    two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    found[two] = table[(data[two].astype(np.int32) & 31) << 6 | data[two + 1] & 63]
    three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
    found[three] = table[(data[three].astype(np.int32) & 15) << 12 | (data[three + 1].astype(np.int32) & 63) << 6 | data[three + 2] & 63]
    found[data >= 0xF0] = _SCRIPTS.index("other")
    owner = np.repeat(np.arange(len(part)), np.diff(part.offsets))
    has = found >= 0
    counts = np.bincount(owner[has] * len(_SCRIPTS) + found[has], minlength=len(part) * len(_SCRIPTS))
    return counts.reshape(len(part), -1).argmax(axis=1)


_SYMBOL = np.zeros(256, np.bool_)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeat_words(part: Slice, hashes: np.ndarray, length: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, words in windows that occur twice or more in that text."""
    at, keys = part.windows(hashes, length)
    again = at[repeated(mix(keys + part.owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[again] += 1  # starts are distinct, and so are ends
    edge[again + length] -= 1
    total = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return total[part.first[1:]] - total[part.first[:-1]]


def token_measures(part: Slice, hashes: np.ndarray, vocabulary: WordIds, is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: tokens, byte tokens, entropy in bits of its token distribution."""
    ids, sizes = vocabulary.ids(vocabulary.codes(part, hashes))
    owner = np.repeat(part.owner, sizes)
    n = np.bincount(owner, minlength=len(part))
    from_bytes = np.bincount(owner, weights=is_byte[ids], minlength=len(part)).astype(np.int64)
    key = np.sort(owner * len(is_byte) + ids)
    edges = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(edges, append=len(key)).astype(np.float64)
    log_sum = np.bincount(key[edges] // len(is_byte), weights=count * np.log2(count), minlength=len(part))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(n > 0, np.log2(n) - log_sum / n, 0.0)
    return n, from_bytes, entropy


MEASURES = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField("script", T.StringType()), T.StructField("n_tokens", T.LongType())]
    + [T.StructField(name, T.DoubleType()) for name in ("chars_per_token", "byte_share", "token_entropy")]
    + [T.StructField("rejected_by", T.StringType())]
)
_ARROW = pa.schema(
    [(name, pa.int64()) for name in MEASURES.fieldNames()[:6]]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("script", pa.string()), ("n_tokens", pa.int64())]
    + [(name, pa.float64()) for name in ("chars_per_token", "byte_share", "token_entropy")]
    + [("rejected_by", pa.string())]
)


class Rules:
    """Measures and verdicts of a batch; one per task, with the vocabulary of its worker."""

    def __init__(self, model_path: str | None, bands: Mapping[str, Band], least_words: int, repeat_percent: int):
        path = model_path or default_path("piece_bpe_32k.model")
        model = piece_model(path)
        self.is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        self.vocabulary = worker_words("piece", path)
        self.bands, self.least_words, self.repeat_percent = bands, least_words, repeat_percent

    def measure(self, part: Slice, langs: list[str | None]) -> dict[str, np.ndarray | list]:
        hashes = part.hashes()
        n_words = part.counts.astype(np.int64)
        chars = part.per_text((part.data & 0xC0) != 0x80) - part.per_text(_space(part.data))
        repeats = repeat_words(part, hashes)
        base = (n_words < self.least_words) | (100 * repeats > self.repeat_percent * n_words)
        tokens, from_bytes, entropy = token_measures(part, hashes, self.vocabulary, self.is_byte)
        safe = np.maximum(tokens, 1)
        fertility, share = chars / safe, from_bytes / safe
        scripts = [_SCRIPTS[i] for i in main_script(part)]
        reasons: list[str | None] = []
        for i, (script, lang) in enumerate(zip(scripts, langs, strict=True)):
            band = self.bands.get(lang or "")
            if band is None or band.script not in (None, script):
                band = self.bands.get(script) or self.bands["other"]
            low, high = band.chars_per_token
            why = ["base"] if base[i] else []
            if tokens[i] and not low <= fertility[i] <= high:
                why.append("chars_per_token")
            if tokens[i] and share[i] > band.byte_share:
                why.append("byte_share")
            if tokens[i] >= band.least_tokens and entropy[i] < band.entropy * np.log2(min(tokens[i], band.entropy_tokens)):
                why.append("token_entropy")
            reasons.append(",".join(why) or None)
        blank = tokens == 0
        return {
            "n_words": n_words,
            "word_chars": chars,
            "n_symbols": part.per_text(_SYMBOL[part.data]),
            "n_dup_lines": np.array([_dup_lines(part.text(i)) for i in range(len(part))], np.int64),
            "n_repeat_words": repeats,
            "base_failed": base,
            "kept": np.array([r is None for r in reasons], np.bool_),
            "script": scripts,
            "n_tokens": tokens,
            "chars_per_token": pa.array(fertility, mask=blank),
            "byte_share": pa.array(share, mask=blank),
            "token_entropy": pa.array(entropy, mask=blank),
            "rejected_by": pa.array(reasons, pa.string()),
        }

    def batch(self, batch: pa.RecordBatch, text: str = "text", lang: str = "lang") -> pa.RecordBatch:
        """Measures of each row of a batch, without ids."""
        langs = batch.column(lang).to_pylist() if lang in batch.schema.names else [None] * batch.num_rows
        found = [
            pa.record_batch(self.measure(part, langs[part.low : part.low + len(part)]), schema=pa.schema(list(_ARROW)[1:]))
            for part in slices(batch.column(text))
        ]
        return pa.Table.from_batches(found, pa.schema(list(_ARROW)[1:])).combine_chunks()


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def quality_measures(
    docs: DataFrame, model_path: str | None = None, bands: Mapping[str, Band] = BANDS, least_words: int = 10, repeat_percent: int = 20
) -> DataFrame:
    """One row of measures and verdict for each document, in one pass without a shuffle."""
    wanted = [docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")]
    wanted += [docs["lang"].cast("string").alias("lang")] if "lang" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(model_path, bands, least_words, repeat_percent)
        for batch in batches:
            if batch.num_rows:
                table = rules.batch(batch).add_column(0, "doc_id", batch.column("doc_id"))
                yield from table.cast(_ARROW).to_batches()

    return docs.select(*wanted).mapInArrow(run, MEASURES)


def keep_good(
    docs: DataFrame, model_path: str | None = None, bands: Mapping[str, Band] = BANDS, least_words: int = 10, repeat_percent: int = 20
) -> DataFrame:
    """The rows whose text passes the base rule and its bands, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(model_path, bands, least_words, repeat_percent)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(rules.batch(batch)["kept"].combine_chunks())

    return docs.mapInArrow(run, docs.schema)
