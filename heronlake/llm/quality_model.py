"""Quality classifier from weak labels.

Overlapping heuristic labellers look at every document and vote good, bad or nothing. Votes are counted by pattern, so
expectation-maximisation, which estimates how each labeller votes on good and on bad documents and the share of good
ones, runs on a table of at most 3^labellers rows whatever the corpus. Its posteriors label the documents; a hashed
linear scorer (words and their shapes, and a few document features, dealt to 2^BITS weights) is fitted to them on a
sample of at most ``SAMPLE`` documents of ``ENOUGH`` words or more, those with the least digests of id and text, and scores all
documents. Training and scoring look at the same features, of whole texts.

The estimates start from majority votes and are held by prior counts, so that a corpus without bad documents isn't
split in two.

Defined cases: null, empty and blank texts score 0 and are not kept; repeated rows score equally; null and repeated ids take part,
and the sample is neither empty nor larger for them; where no text has ``ENOUGH`` words, scores are the share of good documents;
very long texts are read whole; an empty table gives an empty result; extra columns are carried or left out as
asked, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import fresh
from heronlake.llm.quality_rules import STOP_WORDS

BITS = 16
SAMPLE = 8000
SEED = 41
CUT = 0.5
BAD, NONE, GOOD = 0, 1, 2

_SYMBOLS = re.compile(r"[#*$%&|<>~^{}\\]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHAPES = ((re.compile(r"[a-zà-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "9"))
_STOPS = frozenset(STOP_WORDS)

#: Texts of fewer words get no votes from labellers that look at shares.
ENOUGH = 15
#: Labeller, feature, votes bad below, good from, good up to, bad above (None: no bound). Those without a good range
#: only find faults.
LABELLERS: tuple[tuple[str, str, float | None, float | None, float | None, float | None], ...] = (
    ("symbols", "symbols", None, None, None, 0.1),
    ("stop words", "stops", 0.03, 0.08, None, None),
    ("capitals", "capitals", None, None, None, 0.3),
    ("word length", "length", 3.5, 4.0, 7.0, 8.0),
    ("exclamations", "exclaimed", None, None, None, 0.2),
    ("repeated neighbours", "neighbours", None, None, None, 0.2),
    ("variety", "variety", 0.5, None, None, None),
)


def features(text: str) -> tuple[list[str], dict[str, float]]:
    """The words and, if there are any, the numbers that labellers look at."""
    words = text.split()
    n = len(words)
    if not n:
        return words, {}
    chars = sum(map(len, words))
    # of 50 words each, so that long documents compare with short ones
    spans = [words[i : i + 50] for i in range(0, n, 50)]
    return words, {
        "words": n,
        "symbols": len(_SYMBOLS.findall(text)) / n,
        "stops": sum(map(_STOPS.__contains__, words)) / n,
        "capitals": len(_CAPITALS.findall(text)) / chars,
        "length": chars / n,
        "exclaimed": text.count("!") / n,
        "neighbours": sum(map(eq, words, words[1:])) / n,
        "variety": sum(len(set(s)) for s in spans) / n,
    }


def votes(f: dict[str, float]) -> str:
    """A digit for each labeller; all abstain on a very short text."""
    if f.get("words", 0) < ENOUGH:
        return str(NONE) * len(LABELLERS)
    out = []
    for _, name, low, good_from, good_to, high in LABELLERS:
        x = f[name]
        if (low is not None and x < low) or (high is not None and x > high):
            out.append(BAD)
        elif (good_from, good_to) != (None, None) and (good_from is None or x >= good_from) and (good_to is None or x <= good_to):
            out.append(GOOD)
        else:
            out.append(NONE)
    return "".join(map(str, out))


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], list[dict[str, float]]]:
    """(posterior of good by pattern, accuracies of the labellers) by expectation-maximisation.

    ``patterns`` counts documents by votes. A labeller's accuracy on a class is the share of right votes among those
    it gives there.
    """
    import numpy as np

    silent = str(NONE) * len(LABELLERS)
    keys = sorted(k for k in patterns if k != silent)
    if not keys:
        return {silent: 1.0}, []
    v = np.array([[int(c) for c in k] for k in keys])
    n = np.array([patterns[k] for k in keys], dtype=np.float64)
    n_good, n_bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    post = (n_good + 2.0) / (n_good + 3.0 * n_bad + 3.0)
    # prior counts, in all a twentieth of the documents: labellers err rarely, and miss most faults of other kinds
    weight = 0.05 * n.sum()
    faults = [(low, high) == (None, None) for _, _, _, low, high, _ in LABELLERS]
    prior = {
        1: weight * np.array([[0.02, 0.97, 0.01] if only else [0.02, 0.13, 0.85] for only in faults]),
        0: weight * np.array([[0.30, 0.69, 0.01] if only else [0.40, 0.20, 0.40] for only in faults]),
    }
    for _ in range(rounds):
        share = (n @ post + 0.8 * weight) / (n.sum() + weight)
        logs = {}
        for y, p in ((1, post), (0, 1 - post)):
            table = np.stack([prior[y][j] + np.array([(n * p)[v[:, j] == a].sum() for a in (BAD, NONE, GOOD)]) for j in range(v.shape[1])])
            table /= table.sum(1, keepdims=True)
            logs[y] = (np.log(table), table)
        up = np.log(share) + sum(logs[1][0][j, v[:, j]] for j in range(v.shape[1]))
        down = np.log(1 - share) + sum(logs[0][0][j, v[:, j]] for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(down - up, -700, 700)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    good, bad = logs[1][1], logs[0][1]
    accuracies = [
        {"on_good": float(good[j, GOOD] / (good[j, GOOD] + good[j, BAD])), "on_bad": float(bad[j, BAD] / (bad[j, GOOD] + bad[j, BAD]))} for j in range(v.shape[1])
    ]
    # documents without any vote tell nothing, and get the share of good ones
    return {**dict(zip(keys, post.tolist())), silent: float(share)}, accuracies


def _slot(kind: str, what: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{kind}\t{what}".encode(), seed=SEED) & ((1 << BITS) - 1)


def _shape(word: str) -> str:
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return word


class _Slots(dict):
    """The two slots of a word, kept for some hundred thousand words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        out = (_slot("w", word.lower()), _slot("s", _shape(word)))
        if len(self) >= 200_000:
            self.clear()
        self[word] = out
        return out


def _document_slots(f: dict[str, float]) -> list[int]:
    """Slots for the document as a whole: its features, each in one of a few bins."""
    if f["words"] < ENOUGH:
        return []
    bins = {"neighbours": 20, "variety": 10, "capitals": 10, "symbols": 5, "stops": 20}
    return [_slot("d", f"{name}={min(int(f[name] * k), k)}") for name, k in bins.items()]


def fit(slots, values, ends, posteriors, rounds: int = 150, rate: float = 1.0, decay: float = 1e-5):
    """Weights (the last is the bias) of a logistic scorer for documents with these posteriors; the slots and values of all of
    them stand in a row, and ``ends`` says where each document's end. Takes a few times the memory of its input."""
    import numpy as np

    size = 1 << BITS
    w = np.zeros(size + 1)
    if not len(ends):
        return w
    sizes = np.diff(ends, prepend=0)
    starts = ends - sizes
    slots, values, y = slots.astype(np.int64), values.astype(np.float32), np.asarray(posteriors, dtype=np.float64)
    # both classes weigh alike, up to a factor of 10
    weight = np.where(y < 0.5, min(10.0, max(1.0, (y >= 0.5).sum() / max(1, (y < 0.5).sum()))), 1.0)
    weight /= weight.sum()
    square = np.full(size + 1, 1e-8)
    for _ in range(rounds):
        z = np.add.reduceat(w[slots] * values, starts) + w[-1]
        g = weight * (1 / (1 + np.exp(-z)) - y)
        grad = np.append(np.bincount(slots, weights=np.repeat(g, sizes) * values, minlength=size), g.sum()) + decay * w
        square += grad**2
        w -= rate * grad / np.sqrt(square)
    return w


class Model:
    """Posteriors by vote pattern and the scorer's weights: some hundred kilobytes."""

    def __init__(self, posteriors: dict[str, float], accuracies: list[dict[str, float]], weights):
        self.posteriors, self.accuracies, self.weights = posteriors, accuracies, weights

    def score(self, words: list[str], f: dict[str, float], cache: dict[str, float]) -> float:
        import math

        z = self.weights[-1] + sum(map(cache.__getitem__, words)) / len(words) + sum(float(self.weights[s]) for s in _document_slots(f))
        if (n := f["words"]) < ENOUGH:  # few words say little: the score leans to the share of good documents
            share = min(0.999, max(0.001, self.posteriors.get(str(NONE) * len(LABELLERS), 0.5)))
            z = z * n / ENOUGH + math.log(share / (1 - share)) * (1 - n / ENOUGH)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


class _WordWeights(dict):
    def __init__(self, weights):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        a, b = _slot("w", word.lower()), _slot("s", _shape(word))
        out = float(self.weights[a] + self.weights[b])
        if len(self) >= 400_000:
            self.clear()
        self[word] = out
        return out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Votes of all documents, estimates from their patterns, and a scorer fitted on a sample."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = df.select(F.col(text_col).cast("string").alias("text"))

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found: dict[str, int] = {}
            for t in batch.column(0):
                _, f = features(t.as_py() or "")
                if f:
                    v = votes(f)
                    found[v] = found.get(v, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["votes", "n"])

    rows = texts.mapInArrow(counted, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # 3^labellers rows at most
    patterns = {r.votes: r.n for r in rows}
    posteriors, accuracies = estimate(patterns)
    n = sum(patterns.values())
    digest = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(SEED)), F.lit(1_000_000))
    shown = df.select(digest.alias("at"), F.col(text_col).cast("string").alias("text"))
    # about twice the sample is looked at, so that enough is left without short texts
    share = 2 * 1_000_000 * sample // max(n, sample)

    def sampled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        slots = _Slots()
        for batch in batches:
            out = []
            for at, t in zip(batch.column(0), batch.column(1)):
                words, f = features(t.as_py() or "")
                if not words or f["words"] < ENOUGH:
                    continue
                x: dict[int, float] = {}
                for w in words:
                    for s in slots[w]:
                        x[s] = x.get(s, 0.0) + 1 / len(words)
                for s in _document_slots(f):
                    x[s] = x.get(s, 0.0) + 1.0
                slot = sorted(x)
                out.append((at.as_py(), slot, [x[s] for s in slot], posteriors[votes(f)]))
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["at", "s", "x", "y"])

    def drawn(d: DataFrame):
        found = d.mapInArrow(sampled, "at long, s array<int>, x array<float>, y double")
        return found.orderBy("at", "y", F.xxhash64("s"), F.xxhash64("x")).limit(sample).select("s", "x", "y").toArrow()

    table = drawn(shown.where(F.col("at") < share))
    if not table.num_rows and n:
        table = drawn(shown)
    # ordered by digests, so the rows stand alike in each run; no document is without slots
    slots, values = (table.column(c).combine_chunks() for c in ("s", "x"))
    if isinstance(slots, pa.ChunkedArray):
        slots, values = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], kind) for c, kind in ((slots, pa.list_(pa.int32())), (values, pa.list_(pa.float32()))))
    ends = np.cumsum(pc.list_value_length(slots).to_numpy(zero_copy_only=False)).astype(np.int64)
    y = table.column("y").to_numpy()
    return Model(posteriors, accuracies, fit(slots.flatten().to_numpy(), values.flatten().to_numpy(), ends, y))


def _scored(df: DataFrame, model: Model, text_col: str) -> tuple[DataFrame, str, str]:
    """``df`` with score and posterior; the names of these columns."""
    score, posterior = fresh(df, "score", "posterior")
    schema = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(posterior, T.DoubleType())])
    at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        cache = _WordWeights(m.weights)
        for batch in batches:
            scores, posts = [], []
            for t in batch.column(at):
                words, f = features(t.as_py() or "")
                scores.append(round(m.score(words, f, cache), 6) if words else 0.0)
                posts.append(round(m.posteriors.get(votes(f), 0.5), 6) if words else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(posts, pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema), score, posterior


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row for each document: doc_id, posterior (of the labellers; null without words), score (of the scorer), kept."""
    model = model or train(df, id_col, text_col)
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d, score, posterior = _scored(base, model, "text")
    return d.select("doc_id", F.col(posterior).alias("posterior"), F.col(score).alias("score"), (F.col(score) >= CUT).alias("kept"))


def filter_classified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """The rows of ``df`` that are kept, with its columns."""
    d, score, _ = _scored(df, model or train(df, id_col, text_col), text_col)
    return d.where(F.col(score) >= CUT).select(*[d[c] for c in df.columns])
