"""Language identification by averaged hashed subword embeddings and a linear softmax.

* Features: every run of 2 to 4 signs of a lower-cased text in which only the outermost may be a word edge (anything
  but a letter), hashed to `BUCKETS` rows. Whole texts are used.
* Model: the mean of the rows' embeddings (`WIDTH` numbers each) goes through a linear softmax. Stochastic gradient
  descent in numpy trains both, on whole texts and on short excerpts of them, so that short texts score as they should.
* Sample: at most about `PER_LANGUAGE` labelled rows of each of the `MOST_LANGUAGES` most frequent labels, drawn by a
  hash of doc_id and text; that is all that reaches the driver, as counts of hashed subwords.
* Calibration: every fifth sampled row is kept from training. A temperature minimises the log loss there.
* Rejection: noise and languages that were not learned get high softmax scores like any text, but their subwords are new.
  Per language, the share of subwords that training never saw is taken on the rows kept from training, whole and as
  excerpts; all but `REJECT` of them lie below a share, and a text is rejected when it has more than `MARGIN` times
  that share (`LEAST_SHARE` at least), and more than `SLACK` new subwords, about two words, beyond it.
* Prediction: embedding times softmax weights is one small table (BUCKETS x languages), sent to all tasks; its size
  does not depend on the data.

Defined cases: a null text, or one without a letter, is `und` with score 0 and is rejected; rows with a null label are
predicted but not learned from; a null doc_id is predicted, not held out and not learned from; repeated rows give
repeated rows; columns other than doc_id, text and lang are not read. Without any labelled row everything is `und`.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweave.llm.common import in_arrow
from traceweave.llm.transducer import classes_of
from traceweave.llm.words import mix, slices, text_bytes

BUCKETS, WIDTH = 1 << 16, 16
PER_LANGUAGE, MOST_LANGUAGES = 500, 256
EPOCHS, RATE, EXCERPT = 6, 0.5, 60
REJECT, MARGIN, LEAST_SHARE, SLACK = 0.001, 3.0, 0.05, 12
UNKNOWN = "und"

_LOWER: np.ndarray | None = None


def _letters(codes: np.ndarray) -> np.ndarray:
    """Lower-cased letters, and 0 for all other signs."""
    global _LOWER
    if _LOWER is None:
        every = np.arange(0x110000, dtype=np.uint32)
        kinds = classes_of(every)
        # All classes between LETTER and E but digits, other signs and the apostrophe are letters.
        letter = ~np.isin(kinds, (0, 1, 3, 4, 5, 11))
        table = np.where(letter, every, 0).astype(np.uint32)
        for code in np.flatnonzero(letter).tolist():
            small = chr(code).lower()
            if len(small) == 1:
                table[code] = ord(small)
        _LOWER = table
    return _LOWER[codes]


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the subwords of each text, one text after the other, and the n + 1 offsets."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    codes = _letters(np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32))
    at = np.searchsorted(lead, offsets)
    # A word edge before the first text and behind each.
    text = np.repeat(np.arange(n), np.diff(at))
    signs = np.zeros(len(codes) + n + 1, np.uint64)
    signs[np.arange(len(codes)) + text + 1] = codes
    owner = np.zeros(len(signs), np.int64)
    owner[np.arange(len(codes)) + text + 1] = text
    rows, owners = [], []
    inner = signs != 0
    for k in (2, 3, 4):
        m = len(signs) - k + 1
        if m <= 0:
            continue
        good = inner[:m] | inner[k - 1 : k - 1 + m]
        for j in range(1, k - 1):
            good &= inner[j : j + m]
        where = np.flatnonzero(good)
        value = np.full(len(where), k, np.uint64)
        for j in range(k):
            value = value * np.uint64(0x100000001B3) + signs[where + j]
        rows.append((mix(value) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner[np.where(inner[where], where, where + k - 1)])
    rows = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.searchsorted(owners[order], np.arange(n + 1))


@dataclass
class LanguageModel:
    """What prediction needs: scores of each subword for each language."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Subwords that training saw, and the share of others that a text of each language may have.
    seen: np.ndarray
    most_new: np.ndarray

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: no letter), its calibrated probability, and whether the text is accepted."""
        rows, edges = subwords(column)
        sizes = np.diff(edges)
        best, score, good = np.full(len(sizes), -1), np.zeros(len(sizes)), np.zeros(len(sizes), bool)
        held = np.flatnonzero(sizes)
        if len(held) and self.languages:
            sums = np.add.reduceat(self.table[rows], edges[held], axis=0, dtype=np.float64)
            logits = (sums / sizes[held, None] + self.bias) / self.temperature
            chance = _softmax(logits)
            best[held], score[held] = chance.argmax(1), chance.max(1)
            new = np.add.reduceat(~self.seen[rows], edges[held], dtype=np.int64)
            good[held] = new <= sizes[held] * self.most_new[best[held]] + SLACK
        return best, np.clip(score, 0.0, 1.0), good


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subword counts of the sampled texts and of an excerpt of each."""
    for batch in slices(batches, "text"):
        rows, edges = subwords(batch.column("text"))
        ids, counts, bits = [], [], []
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            own, number = np.unique(rows[a:b], return_counts=True)
            ids.append(own)
            counts.append(number.astype(np.int32))
            text = batch.column("text")[i].as_py() or ""
            begin = (i * 7919) % max(1, len(text) - EXCERPT)
            bits.append(np.unique(subwords(pa.array([text[begin : begin + EXCERPT]]))[0]))
        numbers = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array(ids, numbers), pa.array(counts, numbers), pa.array(bits, numbers)],
            names=["doc_id", "lang", "ids", "counts", "excerpt"],
        )


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> LanguageModel:
    """A model from the rows of docs that are labelled and not held out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = texts.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    found = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not found:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, np.zeros(BUCKETS, bool), np.zeros(0))
    share = F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in found], "lang string, share double")
    drawn = usable.join(F.broadcast(shares), "lang").where(share < F.col("share"))  # MOST_LANGUAGES rows
    counted = "doc_id long, lang string, ids array<int>, counts array<int>, excerpt array<int>"
    rows = in_arrow(drawn.select("doc_id", "lang", "text"), _counted, counted).toArrow()
    return fit(rows, epochs)


def fit(rows: pa.Table, epochs: int) -> LanguageModel:
    order = np.lexsort((rows.column("doc_id").to_numpy(),))
    rows = rows.take(pa.array(order))
    labels = rows.column("lang").to_pylist()
    languages = sorted(set(labels))
    target = [languages.index(x) for x in labels]
    whole = [
        (np.array(i.as_py(), np.int64), np.array(c.as_py(), np.float32))
        for i, c in zip(rows.column("ids"), rows.column("counts"), strict=True)
    ]
    part = [np.array(x.as_py(), np.int64) for x in rows.column("excerpt")]
    kept = [i for i in range(len(target)) if i % 5 == 0 and len(whole[i][0])]
    examples = [(w[0], w[1] / w[1].sum(), t) for i, (w, t) in enumerate(zip(whole, target, strict=True)) if i % 5 and len(w[0])]
    examples += [(x, np.full(len(x), 1 / len(x), np.float32), t) for i, (x, t) in enumerate(zip(part, target, strict=True)) if i % 5 and len(x)]
    random = np.random.default_rng(5)
    # Inputs start as small noise, outputs at zero.
    embedding = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = epochs * len(examples), 0
    for _ in range(epochs):
        for i in random.permutation(len(examples)):
            ids, share, label = examples[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            hidden = share @ embedding[ids]
            error = _softmax(hidden @ weights + bias)
            error[label] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * np.float32(0.1) * error
            embedding[ids] -= (rate * share * 20)[:, None] * back
    table = embedding @ weights
    seen = np.zeros(BUCKETS, bool)
    for ids, _, _ in examples:
        seen[ids] = True
    most_new = np.full(len(languages), LEAST_SHARE)
    for label in range(len(languages)):
        own = [i for i in kept if target[i] == label]
        shares = [whole[i][1][~seen[whole[i][0]]].sum() / whole[i][1].sum() for i in own]
        shares += [(~seen[part[i]]).mean() for i in own if len(part[i])]
        if shares:
            most_new[label] = max(LEAST_SHARE, MARGIN * np.quantile(shares, 1 - REJECT))
    if not kept:
        return LanguageModel(languages, table, bias, 1.0, seen, most_new)
    logits = np.array([(whole[i][1] / whole[i][1].sum()) @ table[whole[i][0]] + bias for i in kept], np.float64)
    truth = np.array([target[i] for i in kept])
    grid = np.geomspace(0.25, 8, 41)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    return LanguageModel(languages, table, bias, float(grid[int(np.argmin(losses))]), seen, most_new)


def _predicted(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in slices(batches, "text"):
            best, score, good = known.scores(batch.column("text"))
            out = {
                "lang_pred": pa.array([known.languages[b] if b >= 0 else UNKNOWN for b in best], pa.string()),
                "score": pa.array(score),
                "accepted": pa.array(good),
            }
            yield pa.RecordBatch.from_arrays([out[n] if n in out else batch.column(n) for n in names], names=names)

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row; only the text decides."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "lang_pred", "score", "accepted"]
    return in_arrow(rows, _predicted(sent, names), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs whose text the model accepts, with all their columns."""
    clash = "__text_to_judge"
    names = [*docs.columns]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in slices(batches, clash):
            yield batch.select(names).filter(pa.array(known.scores(batch.column(clash))[2]))

    return in_arrow(docs.withColumn(clash, F.col("text").cast("string")), run, docs.schema)
