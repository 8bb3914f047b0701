"""Quality rules: simple counts, and divergence from a language's usual histograms.

One pass over the text gives each row its counts, a histogram of character
classes and one of common words. The reference of a language is the median
(characters) or mean (words) of the normalised histograms of all its rows that
pass the base rule. A row is
rejected if the Jensen-Shannon distance (base 2, 0 to 1) of its characters or
of its common words to the reference of its language exceeds a limit. Guards:
rows with fewer than MIN_CHARS word characters or MIN_WORDS words, and
languages with fewer than MIN_ROWS rows to refer to, aren't compared.

A null text has no words and fails the base rule; a language without a list
of its own (null included) is compared on the pooled reference of all such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut
from .textkit import U64, chunks, hash_spans, lowered, mix, shingle_hashes, word_hashes, words

# Frequent words of each language.
COMMON = {
    "de": "der die das und in zu den von mit ist des sich auf für ein eine im dem nicht als auch es an werden aus er hat dass sie nach",
    "en": "the of and to in a is that for it was on are as with be at by this from or an have not but which they you were his",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus il ne ce se avec sont aux ou son elle",
}
CHAR_LIMIT = 0.2
WORD_LIMIT = 0.345
MIN_CHARS = 200
MIN_WORDS = 100
MIN_ROWS = 30

# Character classes: lower, upper, digit, common punctuation, symbol, other ASCII, letter beyond ASCII; 7 isn't counted.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[0x20, *range(9, 14)]] = 7
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 7, 6
N_CLASSES = 7
#: Compared classes: without digits, as clean texts may hold long numbers and keys.
_COMPARED = [0, 1, 3, 4, 5, 6]


def _lexicon(lang: str) -> np.ndarray:
    raw = [w.encode() for w in COMMON[lang].split()]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(word_hashes(data, ends - np.diff(ends, prepend=0), ends))


def features(data: np.ndarray, off: np.ndarray, lexicon: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each row; `words_<k>` of lexicon's k-th entry are in the matrix `common`, whose last column is every other word."""
    rows = len(off) - 1
    starts, ends, first = words(data, off)
    row_of_word = np.repeat(np.arange(rows), np.diff(first))
    row_of_byte = np.repeat(np.arange(rows), np.diff(off))
    classes = np.bincount(row_of_byte * 8 + _CLASS[data], minlength=rows * 8).reshape(rows, 8)[:, :N_CLASSES]
    w = word_hashes(data, starts, ends)
    # lines
    begin = np.zeros(len(data) + 1, bool)
    begin[off[:-1]] = True
    begin[1:] |= np.append(data == 10, False)[: len(data)]
    a = np.flatnonzero(begin[: len(data)])
    b = np.append(a[1:], len(data))
    b = b - ((b > a) & (data[np.maximum(b - 1, 0)] == 10)) if len(a) else b
    has = np.searchsorted(starts, a) < np.searchsorted(starts, b)
    a, b = a[has], b[has]
    line_row = np.searchsorted(off, a, "right") - 1
    lines = hash_spans(data, a, b) ^ mix(line_row.astype(U64))
    _, once = np.unique(lines, return_index=True)
    dup = np.bincount(line_row, minlength=rows) - np.bincount(line_row[once], minlength=rows)
    # words in 3-word windows that the row has twice
    three = shingle_hashes(w, 3)
    inside = np.flatnonzero(row_of_word[: len(three)] == row_of_word[2:]) if len(three) else np.zeros(0, np.int64)
    _, inverse, count = np.unique(three[inside] ^ mix(row_of_word[inside].astype(U64)), return_inverse=True, return_counts=True)
    at = inside[count[inverse] > 1]
    rep = np.zeros(len(w), bool)
    for j in range(3):
        rep[at + j] = True
    low = word_hashes(lowered(data), starts, ends)
    place = np.searchsorted(lexicon, low)
    place[place == len(lexicon)] = 0
    place = np.where(lexicon[place] == low, place, len(lexicon)) if len(low) else place
    width = len(lexicon) + 1
    return {
        "n_words": np.diff(first), "word_chars": classes.sum(1) + 0, "n_symbols": classes[:, 4], "n_dup_lines": dup, "n_repeat_words": np.bincount(row_of_word[rep], minlength=rows),
        "classes": classes, "common": np.bincount(row_of_word * width + place, minlength=rows * width).reshape(rows, width),
    }


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs = sorted(COMMON)
    lists = {x: _lexicon(x) for x in langs}
    every = np.unique(np.concatenate(list(lists.values())))
    # columns of the joint list that belong to a language; the rest counts as another word
    own = {x: np.searchsorted(every, lists[x]) for x in langs}
    for batch in batches:
        known = [x if x in lists else "" for x in batch.column("lang").to_pylist()]
        for r0, r1, data, off in chunks(batch.column("text")):
            f = features(data, off, every)
            rows, total = [], f["common"].sum(1)
            for i in range(r1 - r0):
                mine = f["common"][i][own[known[r0 + i]]] if known[r0 + i] else f["common"][i][:0]
                rows.append(np.append(mine, total[i] - mine.sum()).astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(r0, r1 - r0), pa.array(known[r0:r1])]
                + [pa.array(f[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                + [pa.array(f["classes"].astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(rows, pa.list_(pa.int32()))],
                names=["doc_id", "known", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"],
            )


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of the rows of p to q; rows of zeros are at distance 0."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    q = np.broadcast_to(q / max(q.sum(), 1e-300), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(p.sum(1) > 0, np.sqrt(np.maximum(d, 0) / 2), 0.0)


def _judge(reference: dict[str, tuple[int, list[float], list[float]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.array(batch.column("known").to_pylist(), object)
            n = batch.num_rows
            char_js, word_js = np.zeros(n), np.zeros(n)
            classes, common = batch.column("classes").to_pylist(), batch.column("common").to_pylist()
            for lang, (rows, c, w) in reference.items():
                at = np.flatnonzero(known == lang)
                if len(at) and rows >= MIN_ROWS:
                    char_js[at] = js_distance(np.array([classes[i] for i in at], float)[:, _COMPARED], np.array(c)[_COMPARED])
                    word_js[at] = js_distance(np.array([common[i] for i in at], float), np.array(w))
            n_words, chars = batch.column("n_words").to_numpy(), batch.column("word_chars").to_numpy()
            failed = (n_words < 50) | (100 * batch.column("n_repeat_words").to_numpy() > 50 * n_words)
            odd = ((chars >= MIN_CHARS) & (char_js > CHAR_LIMIT)) | ((n_words >= MIN_WORDS) & (word_js > WORD_LIMIT))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), pa.array(failed), pa.array(~failed & ~odd), pa.array(char_js), pa.array(word_js)], names=[*_KEPT, "base_failed", "kept", "char_js", "word_js"])

    return run


_KEPT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): counts, base_failed, kept, char_js, word_js."""
    counted = cut(docs.select("doc_id", "text", "lang").mapInArrow(_count, "doc_id long, known string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<int>, common array<int>"))
    fit = counted.filter("n_words >= 50 and 2 * n_repeat_words <= n_words")
    width = {x: len(COMMON[x].split()) + 1 for x in COMMON} | {"": 1}
    share = lambda c, k: F.percentile_approx(F.col(c)[k] / F.greatest(F.aggregate(c, F.lit(0), lambda a, x: a + x), F.lit(1)), 0.5, 1000)
    means = fit.groupBy("known").agg(F.count("*").alias("n"), *(share("classes", k).alias(f"c{k}") for k in range(N_CLASSES)), *(F.avg(F.get("common", F.lit(k)) / F.greatest("n_words", F.lit(1))).alias(f"w{k}") for k in range(max(width.values()))))
    # at most one row for each language that has a list, and one for all others
    reference = {r["known"]: (r["n"], [r[f"c{k}"] or 0.0 for k in range(N_CLASSES)], [r[f"w{k}"] or 0.0 for k in range(width[r["known"]])]) for r in means.collect()}
    schema = ", ".join(f"{c} long" for c in _KEPT) + ", base_failed boolean, kept boolean, char_js double, word_js double"
    return counted.mapInArrow(_judge(reference), schema)
