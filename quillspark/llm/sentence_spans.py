"""Operator 7, substring dedup by sliding sentence spans.

A sentence ends after a word with a closing mark or after one word in ``CUT``, chosen by the word itself, so
that prose without marks has sentences too and the same words are cut alike wherever they stand. Words are
compared lower-cased, and blanks between them don't count. Every run of at least ``span`` consecutive
sentences, continued until it holds ``min_words`` words, is hashed and the hashes are joined globally; the
first span of each hash, by (id, sentence), stays, and every sentence that lies in a later one goes. Only
hashes that occur twice go on as a staged table, so that a very frequent passage can be split between tasks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Tables, null_safe

CUT = 4
_WORD = re.compile(r"\S+\s*")
_CLOSING = "\"')]}»”’"
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Hash of a folded word, its lowest bit set if a sentence ends there; emptied when large, which changes no answer."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        end = word.rstrip(_CLOSING)[-1:] in (".", "!", "?") or (h >> 1) % CUT == 0
        h = self[word] = h | 1 if end else h & ~1
        return h


_words = _Words()


def _parsed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the number of words before each sentence and before the end."""
    folded = text.lower().split()
    h = np.fromiter(map(_words.__getitem__, folded), np.uint64, len(folded))
    ends = np.flatnonzero(h & np.uint64(1)) + 1
    last = [len(h)] if len(h) and (not len(ends) or ends[-1] < len(h)) else []
    return h, np.concatenate(([0], ends, last)).astype(np.int64)


def sentences(text: str) -> list[str]:
    """Cut ``text`` into sentences; blanks belong to the sentence before them, or to the first, and joined they are the text."""
    _, bounds = _parsed(text)
    ends = np.array([0, *(m.end() for m in _WORD.finditer(text))])[bounds].tolist()
    return [text[a:b] for a, b in zip([0, *ends[1:]], ends[1:])]


def _runs(h: np.ndarray, bounds: np.ndarray, span: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, number of sentences and two hashes of each run."""
    first = np.arange(len(bounds) - 1)
    end = np.maximum(first + span, np.searchsorted(bounds, bounds[:-1] + min_words))
    first = first[end < len(bounds)]
    end = end[: len(first)]
    a, b, keys = bounds[first], bounds[end], []
    with np.errstate(over="ignore"):
        for k, base in enumerate(_BASES):  # polynomial hashes by differences of prefix sums
            power, back = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(h), x)))) for x in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64))))
            own = h if k == 0 else (h ^ (h >> np.uint64(32))) * _MIX
            upto = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(own * power[:-1]))) if len(h) else np.zeros(1, np.uint64)
            x = (upto[b] - upto[a]) * back[a]
            keys.append(((x ^ (x >> np.uint64(29))) * _MIX + (b - a).astype(np.uint64)).view(np.int64))
    return first, end - first, *keys


def _spans(span: int, min_words: int):
    def run(batches):
        for batch in batches:
            rows, parts = [], [[], [], []]
            for i, text in enumerate(batch.column(2)):
                at, _, k1, k2 = _runs(*_parsed(text.as_py() or ""), span, min_words)
                rows.append(np.full(len(at), i))
                for c, v in zip(parts, (at, k1, k2)):
                    c.append(v)
            if not rows:
                continue
            take = pa.array(np.concatenate(rows))
            at, k1, k2 = map(np.concatenate, parts)
            arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(k1), pa.array(k2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_h", "at", "k1", "k2"])

    return run


def _drop(span: int, min_words: int):
    """Rows (_id, text, first sentences of the spans to go) -> the text without them, and counts."""

    def run(batches):
        for batch in batches:
            texts, total, gone, runs = [], [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                h, bounds = _parsed(text or "")
                hit = np.zeros(len(bounds), bool)
                if starts:
                    first, sizes, _, _ = _runs(h, bounds, span, min_words)
                    for i in np.searchsorted(first, sorted(starts)).tolist():
                        hit[first[i] : first[i] + sizes[i]] = True
                    text = "".join(t for t, x in zip(sentences(text), hit) if not x)
                texts.append(text)
                total.append(len(bounds) - 1)
                gone.append(int(hit.sum()))
                runs.append(int((hit[1:] & ~hit[:-1]).sum() + hit[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (total, gone, runs))], names=["_id", "text", "n_sentences", "n_removed", "n_spans"])

    return run


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3, min_words: int = 25) -> DataFrame:
    """Remove sentences covered by a span that occurred before.

    A span is a run of ``span`` or more consecutive sentences, as many as it takes to hold ``min_words`` words;
    one starts at each sentence. "Before" is by id (null first), then hash of the text, then place in the text.
    Returns ``(id, text, n_sentences, n_removed, n_spans)`` with a row for each input row. Null text stays null;
    it and empty or blank text have no sentences, and a text of fewer words or sentences has no span. Rows that
    repeat both id and text count as one place, so that they keep or lose the same sentences. An empty table
    gives an empty table; other columns are ignored.
    """
    stage = Tables()
    key = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_t"))
    kind = key.schema["_id"].dataType.simpleString()
    shared = key.groupBy("_id").agg(F.min("_h").alias("a"), F.max("_h").alias("b")).where("a <> b")
    if not shared.head(1):  # ids tell texts apart by themselves, so that spans needn't carry the hash
        key = key.withColumn("_h", F.lit(0).cast("long"))
    spans = stage(key.select("_id", "_h", "_t").mapInArrow(_spans(span, min_words), f"_id {kind}, _h long, at int, k1 long, k2 long"), "spans")
    twice = stage(spans.groupBy("k1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k1"), "twice")  # half the key tells most
    found = stage(spans.join(twice, "k1"), "found")
    stage.drop(spans, twice)
    place = F.struct(F.col("_id").isNotNull().alias("x"), "_id", "_h", "at")
    first = stage(found.groupBy("k1", "k2").agg(F.min(place).alias("first")), "first")
    later = found.join(first, ["k1", "k2"]).where(place != F.col("first"))
    later = stage(later.groupBy("_id", "_h").agg(F.collect_set("at").alias("starts")), "later")
    stage.close(later)
    out = key.join(later, null_safe(key, later, "_id", "_h"), "left").select(key["_id"], "_t", "starts")
    return out.mapInArrow(_drop(span, min_words), f"_id {kind}, text string, n_sentences long, n_removed long, n_spans long").withColumnRenamed("_id", id_col)


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
