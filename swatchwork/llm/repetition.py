"""Quality rules by repetition coverage: how much of a text lies inside n-grams and lines that it repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm import common, textbatch

#: Largest share of word characters inside n-grams that the text has more than once, first places included.
NGRAM_SHARE = {5: 0.45, 6: 0.44, 7: 0.43, 8: 0.42, 9: 0.41, 10: 0.40}
#: Largest share of word characters inside the one n-gram that covers most.
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
LINE_SHARE, LINE_CHAR_SHARE, SYMBOL_SHARE, MIN_WORDS = 0.30, 0.40, 0.10, 50
#: A repeated span says something about the text only from this many places on.
LEAST_PLACES = 4
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))

SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
    base_failed boolean, kept boolean, dup_line_share double, dup_line_char_share double,
    top_ngram_share array<double>, dup_ngram_share array<double>, failed_rules array<string>"""


def _marked(keys: np.ndarray) -> np.ndarray:
    """True where a key stands more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for the words inside the n-grams that begin at the given words."""
    steps = np.zeros(size + 1, np.int32)
    steps[at] += 1
    steps[at + n] -= 1
    return np.cumsum(steps[:-1]) > 0


def measure(piece: textbatch.Piece) -> dict[str, np.ndarray]:
    """All counts of one piece, an entry for each row."""
    n, ratio = piece.n, lambda a, b: np.divide(a, b, out=np.zeros(len(b)), where=b > 0)
    s, e, row = piece.cuts()
    chars = piece.chars()
    length = chars[e] - chars[s]
    per_row = lambda which, weights=None: np.bincount(which, weights, n)
    out = {"n_words": per_row(row), "word_chars": per_row(row, length).astype(np.int64), "n_symbols": piece.per_row(SYMBOLS[piece.data])}
    word = textbatch.mixed(piece.hashes(s, e) + np.uint64(1))
    salt = textbatch.mixed(np.arange(1, n + 1, dtype=np.uint64))

    # lines: from a row's start or the byte after \n up to the next of these
    cut = np.flatnonzero(piece.data == 10)
    ls = np.sort(np.concatenate([piece.starts[:-1], cut + 1]))
    lrow = np.searchsorted(piece.starts[1:], ls, "right")
    inside = lrow < n
    ls, lrow = ls[inside], lrow[inside]
    le = np.minimum(np.append(ls[1:], len(piece.data)), piece.starts[lrow + 1])
    le = le - ((le > ls) & (piece.data[np.maximum(le, 1) - 1] == 10) if len(piece.data) else 0)
    first_word = np.searchsorted(s, ls)
    full = (first_word < len(s)) & (np.append(s, np.iinfo(np.int64).max)[first_word] < le)
    ls, le, lrow = ls[full], le[full], lrow[full]
    line = piece.hashes(ls, le) + np.uint64(0x5851F42D4C957F2D) * (le - ls).astype(np.uint64) + salt[lrow]
    _, first, back = np.unique(line, return_index=True, return_inverse=True)
    later = np.ones(len(line), bool)
    later[first] = False
    lines, dup = per_row(lrow), per_row(lrow[later])
    out["n_dup_lines"] = dup
    out["dup_line_share"] = ratio(dup, lines)
    out["dup_line_char_share"] = ratio(per_row(lrow[later], (chars[le] - chars[ls])[later]), np.diff(chars[piece.starts]))

    top, covered = [], []
    for k in range(2, 11):
        key, at = textbatch.ngrams(word, row, k)
        key = key + salt[row[at]]
        twice = _marked(key)
        key, at = key[twice], at[twice]
        if k == 3:
            out["n_repeat_words"] = per_row(row[_covered(at, k, len(row))])
        if k in TOP_SHARE:
            best = np.zeros(n)
            if len(key):
                _, first, back, places = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                held = np.concatenate([[0], np.cumsum(length)])
                weight = (held[at + k] - held[at])[first] * places * (places >= LEAST_PLACES)
                np.maximum.at(best, row[at[first]], weight)
            top.append(ratio(best, out["word_chars"]))
        if k in NGRAM_SHARE:
            inside = _covered(at, k, len(row))
            covered.append(ratio(per_row(row[inside], length[inside]), out["word_chars"]))
    out["top"], out["covered"] = np.array(top).T.reshape(n, -1), np.array(covered).T.reshape(n, -1)
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in textbatch.pieces(batch.column("text")):
            m = measure(piece)
            base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            rules = {f"top_{k}gram": m["top"][:, i] > most for i, (k, most) in enumerate(TOP_SHARE.items())}
            rules |= {f"dup_{k}gram": m["covered"][:, i] > most for i, (k, most) in enumerate(NGRAM_SHARE.items())}
            rules |= {"dup_lines": (m["dup_line_share"] > LINE_SHARE) & (m["n_dup_lines"] >= LEAST_PLACES - 1), "dup_line_chars": m["dup_line_char_share"] > LINE_CHAR_SHARE}
            rules["symbols"] = m["n_symbols"] > SYMBOL_SHARE * np.maximum(m["word_chars"], 1)
            failed = np.array(list(rules.values()))
            names = np.array(list(rules))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(piece.first, piece.n).cast(pa.int64()),
                    *(pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    pa.array(base),
                    pa.array(~base & ~failed.any(0)),
                    pa.array(m["dup_line_share"]),
                    pa.array(m["dup_line_char_share"]),
                    pa.array(m["top"].tolist(), pa.list_(pa.float64())),
                    pa.array(m["covered"].tolist(), pa.list_(pa.float64())),
                    pa.array([names[f].tolist() for f in failed.T], pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_share", "dup_line_char_share", "top_ngram_share", "dup_ngram_share", "failed_rules"],
            )


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not looked at), in one pass without a shuffle.

    Words, lines and n-grams of 2 to 10 words are hashed with rolling 64-bit hashes, several texts at a time, and the
    word characters inside repeated n-grams and lines are measured. ``failed_rules`` names each limit that was passed.

    Null and empty texts have no words and fail the base rule. A text of any length is measured whole. Repeated rows
    give repeated results. An empty table gives an empty table. A null doc_id stays null.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_judge, SCHEMA)


def op1_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(common.table(spark, sf_dir, "documents"))
