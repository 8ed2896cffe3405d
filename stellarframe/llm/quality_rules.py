"""Quality rules: counts of a text, and the Jensen-Shannon distance of its histograms from language references.

Words are `[^\\x20\\x09-\\x0D]+`. Two histograms of a text - character classes, and common words against all others -
are compared with the reference of its language; a text of unknown or null language is compared with every reference
and the nearest counts. The distance (base 2, 0 to 1) is judged only above a minimum length, since short texts have
noisy histograms.

Defined cases: a null or blank text has no words and fails the base rule; a very long text is counted whole; of references that
are equally near the distance is the same; repeated rows are judged alike; extra columns pass through, and a column named like a
result is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: The guards: fewer words or letters than these and a distance is not judged.
MIN_JUDGED_WORDS = 40
MIN_JUDGED_CHARS = 200
MAX_CLASS_DISTANCE = 0.30
#: A text without common words is at 0.486 from every reference. Of 40 words drawn from a reference, or with 30 % common
#: words in its proportions, 99.9 % of the samples are below 0.46; longer prose is nearer.
MAX_WORD_DISTANCE = 0.46
#: Beyond so many words, windows are kept as numbers rather than as tuples.
LONG_WORDS = 50_000
SYMBOLS = "[#*$%&|<>]"

#: Reference shares of character classes, fixed values: vowel, consonant, accented or other letter, capital, digit, blank, punctuation, symbol.
CLASS_REFERENCE = {
    "en": (0.305, 0.480, 0.001, 0.020, 0.004, 0.165, 0.024, 0.001),
    "de": (0.305, 0.480, 0.018, 0.035, 0.004, 0.135, 0.022, 0.001),
    "fr": (0.345, 0.420, 0.035, 0.017, 0.004, 0.155, 0.023, 0.001),
    "es": (0.370, 0.410, 0.022, 0.018, 0.004, 0.155, 0.020, 0.001),
}
#: Common words of each language, fixed values; their reference shares fall off as 1 / (rank + 2).
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are as with be by this from or at an have not he they but we you his".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le es este ha si".split(),
}
#: Share of all common words together in running text.
COMMON_SHARE = 0.40
_CLASSES = {**{ord(c): "v" for c in "aeiou"}, **{ord(c): "c" for c in "bcdfghjklmnpqrstvwxyz"}, **{ord(c): "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{ord(c): "0" for c in "0123456789"}, **{ord(c): " " for c in " \t\n\x0b\x0c\r"}, **{ord(c): "." for c in ".,;:!?'\"()-"}}
_ORDER = "vclU0 .s"
_ADDED = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(), "base_failed": T.BooleanType(), "class_distance": T.DoubleType(), "word_distance": T.DoubleType(), "kept": T.BooleanType()}


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    side = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return max(0.0, (side(p) + side(q)) / 2) ** 0.5


def _class_table() -> np.ndarray:
    """The class of each Latin-1 byte."""
    return np.array([_ORDER.index(_CLASSES.get(i, "l" if chr(i).isalpha() else "s")) for i in range(256)], np.int64)


_TABLE = _class_table()


def class_histogram(text: str) -> np.ndarray:
    """Counts of the eight character classes; letters beyond Latin-1 count as other letters."""
    try:
        return np.bincount(_TABLE[np.frombuffer(text.encode("latin-1"), np.uint8)], minlength=8).astype(float)
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.bincount(_TABLE[points[points < 256]], minlength=8).astype(float)
        for point, n in zip(*np.unique(points[points >= 256], return_counts=True), strict=True):
            low[_ORDER.index("l" if chr(point).isalpha() else "s")] += n
        return low


def word_reference(lang: str) -> np.ndarray:
    shares = np.array([1 / (i + 2) for i in range(len(COMMON_WORDS[lang]))])
    return np.append(COMMON_SHARE * shares / shares.sum(), 1 - COMMON_SHARE)


_COMMON = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}


def word_histogram(counts: Counter, lang: str) -> np.ndarray:
    """Counts of the common words of `lang`, all other words last."""
    out = np.zeros(len(COMMON_WORDS[lang]) + 1)
    for w, n in counts.items():
        out[_COMMON[lang].get(w, -1)] += n
    return out


def _repeated_in_long(words: list, size: int) -> int:
    """The same by arrays: windows are numbered exactly, one word longer each time."""
    codes: dict = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    window = ids
    for k in range(1, size):
        window = np.unique(window[: len(ids) - k] * len(codes) + ids[k:], return_inverse=True)[1]
    hit = np.bincount(window)[window] > 1
    depth = np.zeros(len(words) + 1, np.int64)
    depth[: len(hit)] += hit
    depth[size : size + len(hit)] -= hit
    return int((np.cumsum(depth)[:-1] > 0).sum())


def repeated_words(words: list, size: int = 5) -> int:
    """Words that lie in windows of `size` words found twice or more, the first occurrence included."""
    if len(words) <= size:
        return 0
    if len(words) > LONG_WORDS:
        return _repeated_in_long(words, size)
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.array([counts[w] > 1 for w in windows])
    depth = np.zeros(len(words) + 1, np.int64)
    depth[:-size] += hit
    depth[size:] -= hit
    return int((np.cumsum(depth)[:-1] > 0).sum())


def measure(text: str | None, lang: str | None, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> tuple:
    """The result columns of one text, in the order of the schema."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    n_symbols = sum(map(text.count, SYMBOLS[1:-1]))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    repeat = repeated_words(words)
    failed = n < min_words or 100 * repeat > max_repeat * n
    by_class = by_word = None
    if n:
        refs = [lang] if lang in CLASS_REFERENCE else list(CLASS_REFERENCE)
        # lower-cased, without the punctuation that clings to a word
        plain = Counter(raw.lower().translate(None, b".,;:!?\"()").split())
        shape = class_histogram(text)
        by_class = min(js_distance(shape, np.array(CLASS_REFERENCE[r])) for r in refs)
        by_word = min(js_distance(word_histogram(plain, r), word_reference(r)) if plain else 1.0 for r in refs)
    judged = n >= MIN_JUDGED_WORDS and word_chars >= MIN_JUDGED_CHARS
    kept = not failed and not (judged and (by_class > max_class or by_word > max_word))
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeat, failed, by_class, by_word, kept


def apply_rules(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] | None = None, **limits) -> DataFrame:
    """`docs` with the counts, base_failed, both distances (null without words) and kept.

    `keep` names the columns of `docs` that are wanted, all unless given; others, such as the text, are not sent back.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in _ADDED]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(k, v) for k, v in _ADDED.items()]])
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(lang_col).to_pylist() if lang_col in b.schema.names else [None] * b.num_rows
            made = list(zip(*(measure(t.as_py(), g, **limits) for t, g in zip(b.column(text_col), langs, strict=True)), strict=True)) or [[] for _ in _ADDED]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(m, t) for m, t in zip(made, types, strict=True)]], names=schema.names)

    sent = dict.fromkeys([*kept, text_col, *([lang_col] if lang_col in docs.columns else [])])
    return docs.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, schema)


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """The documents that the rules keep, with their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(lang_col) if lang_col in b.schema.names else pa.nulls(b.num_rows, pa.string())
            yield b.filter(pa.array([measure(t.as_py(), g.as_py(), **limits)[-1] for t, g in zip(b.column(text_col), langs, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
