"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and the beginnings of longer words (so inflected forms share a term), hashed to 32 bits and
counted as present or not. The machine adds a weight for each term and, for each pair of terms, the product of two short factor vectors,
so a pair such as an insult with a group's name has a say of its own. The pair sums cost one pass over the terms:
half of (sum of vectors) squared less the sum of squares.

The machine is fitted on a bounded sample of labelled rows. Terms get weights, kept sorted by hash, if their own presence goes with
the label, or if the presence of two of them together does beyond what each does alone; all other terms count nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import map_batches, stored

#: Bound of the training sample: labelled rows, chosen by a hash of the id, whole texts.
SAMPLE_ROWS = 12_000
#: Terms with a weight are in at least so many sampled texts.
LEAST_TEXTS = 3
FACTORS = 4
#: A term gets a weight only if it tells the labels apart: its log-likelihood ratio (G squared) reaches this.
LEAST_RATIO = 12.0
#: Two terms, each in that share of the texts, get weights if their joint ratio exceeds the sum of their own by so much.
PAIR_SHARE, PAIR_RATIO = 0.03, 40.0
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
#: ASCII signs and digits separate words; A-Z are lower-cased.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Term lists that a worker keeps.
CACHE_WORDS = 80_000


class Machine(NamedTuple):
    terms: np.ndarray  # sorted hashes
    w: np.ndarray
    v: np.ndarray
    bias: float
    scale: float
    shift: float


class Terms(dict):
    """A word to the hashes of its terms, as little-endian bytes."""

    def __missing__(self, word: bytes) -> bytes:
        letters = word.decode("utf-8", "ignore")
        names = [b"w" + word] + [b"p%d" % n + letters[:n].encode() for n in PREFIXES if len(letters) > n]
        found = b"".join([xxhash.xxh32_digest(x, 11) for x in names])
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


TERMS = Terms()


def terms_of(text: str | None) -> np.ndarray:
    """Distinct term hashes of a whole text, sorted."""
    words = set((text or "").lower().encode("utf-8", "surrogatepass").translate(WORD_TABLE).split())
    return np.unique(np.frombuffer(b"".join([TERMS[w] for w in words]), ">u4").astype(np.uint32))


def _raw(machine: Machine, found: list[np.ndarray]) -> np.ndarray:
    lengths = np.array([len(x) for x in found])
    out = np.full(len(found), machine.bias)
    if not lengths.sum() or not len(machine.terms):
        return out
    flat = np.concatenate(found)
    at = np.minimum(np.searchsorted(machine.terms, flat), len(machine.terms) - 1)
    hit = machine.terms[at] == flat
    owner = np.repeat(np.arange(len(found)), lengths)[hit]
    at = at[hit]
    if len(at):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        v = machine.v[at].astype(np.float64)
        pairs = 0.5 * (np.add.reduceat(v, first, axis=0) ** 2 - np.add.reduceat(v**2, first, axis=0)).sum(axis=1)
        out[owner[first]] += np.add.reduceat(machine.w[at].astype(np.float64), first) + pairs
    return out


def scores(machine: Machine, found: list[np.ndarray]) -> np.ndarray:
    z = machine.scale * _raw(machine, found) + machine.shift
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def ratio(seen: np.ndarray, ones: np.ndarray, n: float, all_ones: float) -> np.ndarray:
    """G squared of a cell: `seen` texts of n, `ones` of these with label 1, against all texts."""
    due = seen * all_ones / n
    part = lambda x, d: 2 * np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(d, 1e-9)), 0)
    return part(ones, due) + part(seen - ones, seen - due)


def telling(terms: np.ndarray, texts: np.ndarray, with_one: np.ndarray, n: int, ones: float) -> np.ndarray:
    """Which terms of several texts go with the label by their own presence."""
    g = ratio(texts, with_one, n, ones) + ratio(n - texts, ones - with_one, n, ones)
    return (texts >= LEAST_TEXTS) & (g >= LEAST_RATIO)


def paired(terms: np.ndarray, found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Which terms go with the label in a pair: the four cells of two terms tell more than the two terms do one by one."""
    has = np.zeros((len(found), len(terms)), np.float32)
    for i, x in enumerate(found):
        has[i, np.isin(terms, x, assume_unique=True)] = 1
    n, ones = len(y), y.sum()
    both, both_one = has.T @ has, has[y == 1].T @ has[y == 1]
    texts, with_one = np.diag(both).astype(np.float64), np.diag(both_one).astype(np.float64)
    own = ratio(texts, with_one, n, ones) + ratio(n - texts, ones - with_one, n, ones)
    out = np.zeros(len(terms), bool)
    for a in range(len(terms)):
        s, o = both[a].astype(np.float64), both_one[a].astype(np.float64)
        joint = ratio(s, o, n, ones) + ratio(texts[a] - s, with_one[a] - o, n, ones) + ratio(texts - s, with_one - o, n, ones) + ratio(n - texts[a] - texts + s, ones - with_one[a] - with_one + o, n, ones)
        near = joint - own[a] - own >= PAIR_RATIO
        near[a] = False
        # Two terms that nearly always come together have no say beyond each other's.
        near &= np.minimum(np.minimum(s, texts[a] - s), texts - s) >= LEAST_TEXTS
        out |= near
        out[a] |= near.any()
    return out


def chosen_terms(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Terms that tell alone or in a pair, of texts at hand."""
    terms, place, texts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    with_one = np.bincount(place, np.repeat(y, [len(x) for x in found]), len(terms))
    alone = telling(terms, texts, with_one, len(y), y.sum())
    often = terms[texts >= max(LEAST_TEXTS, PAIR_SHARE * len(y))]
    return np.union1d(terms[alone], often[paired(often, found, y)] if len(often) else often)


def fit(found: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = 16, seed: int = 5, kept: np.ndarray | None = None) -> Machine:
    """Adaptive gradient steps on log loss; every fifth text is held back to calibrate, then weights stay as they are.

    kept: the terms with weights, chosen from the other texts if not given.
    """
    none = Machine(np.zeros(0, np.uint32), np.zeros(0, np.float32), np.zeros((0, factors), np.float32), 0.0, 1.0, 0.0)
    y = np.asarray(labels, np.float64)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return none._replace(bias=base)
    rng = np.random.default_rng(seed)
    back = np.arange(len(y)) % 5 == 4
    kept = chosen_terms([x for x, b in zip(found, back, strict=True) if not b], y[~back]) if kept is None else kept
    if not len(kept):
        return none._replace(bias=base)
    w, v = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), factors))
    gw, gv, bias, gb = np.full(len(kept), 1.0), np.full((len(kept), factors), 1.0), base, 1.0
    rows = [np.flatnonzero(np.isin(kept, x, assume_unique=True)) for x in found]
    train = np.flatnonzero(~back)
    weight = np.where(y == 1, min(10.0, max(1.0, 0.3 * (1 - prior) / prior)), 1.0)
    for _ in range(epochs):
        rng.shuffle(train)
        for a in range(0, len(train), 64):
            batch = [i for i in train[a : a + 64] if len(rows[i])]
            if not batch:
                continue
            at = np.concatenate([rows[i] for i in batch])
            n = np.array([len(rows[i]) for i in batch])
            first, owner = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(batch)), n)
            own = v[at]
            total = np.add.reduceat(own, first, axis=0)
            z = bias + np.add.reduceat(w[at], first) + 0.5 * (total**2 - np.add.reduceat(own**2, first, axis=0)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[batch]) * weight[batch] / len(batch)
            terms, place = np.unique(at, return_inverse=True)
            dw = np.bincount(place, g[owner], len(terms)) + 1e-5 * w[terms]
            pair = g[owner][:, None] * (total[owner] - own)
            dv = np.stack([np.bincount(place, pair[:, k], len(terms)) for k in range(factors)], axis=1) + 1e-4 * v[terms]
            gw[terms] += (dw * 30) ** 2
            gv[terms] += (dv * 30) ** 2
            gb += g.sum() ** 2
            w[terms] -= 3.0 * dw / np.sqrt(gw[terms])
            v[terms] -= 0.5 * dv / np.sqrt(gv[terms])
            bias -= 0.3 * g.sum() / gb**0.5
    machine = Machine(kept, w.astype(np.float32), v.astype(np.float32), float(bias), 1.0, 0.0)
    return calibrated(machine, _raw(machine, [x for x, b in zip(found, back, strict=True) if b]), y[back])


def calibrated(machine: Machine, z: np.ndarray, y: np.ndarray) -> Machine:
    """Scale and shift of the log-odds (Platt) from held-back texts, drawn towards 1 and 0."""
    if not len(y):
        return machine
    a, b = 1.0, 0.0
    z = np.clip(z, -50, 50)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.array([((p - y) * z).sum() + (a - 1), (p - y).sum() + 0.1 * b])
        q = p * (1 - p)
        h = np.array([[(q * z * z).sum() + 1, (q * z).sum()], [(q * z).sum(), q.sum() + 0.1]])
        da, db = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = max(0.1, a - da), b - db
    return machine._replace(scale=float(a), shift=float(b))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame | None:
    """(id, label, back, terms), stored: all terms of at most `rows` labelled texts, the ones with the least hash of the id.

    back: every fifth is held back. The driver gets the ids only. A null label or id, or a label that isn't 0 or 1, is left out; of
    several labels of an id the largest counts, of several texts one.
    """
    labelled = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = sorted((r["id"], r["label"]) for r in labelled.orderBy(F.xxhash64(F.lit("toxic"), "id"), "id").limit(rows).collect())
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame([(i, y, k % 5 == 4) for k, (i, y) in enumerate(chosen)], "id long, label int, back boolean")
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id").select("id", "label", "back", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [terms_of(x).astype(np.int64) for x in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["id", "label", "back", "terms"])

    return stored(map_batches(wanted, work, "id long, label int, back boolean, terms array<long>").dropDuplicates(["id"]), "labelled")


def trained(docs: DataFrame, labels: DataFrame, **options) -> Machine:
    """A machine fitted on a sample of labelled texts; terms are counted by Spark, and the driver gets only terms that may have weights."""
    held = sample(docs, labels, **options)
    if held is None:
        return fit([], np.zeros(0))
    n, ones = held.where("not back").agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not 0 < ones < n:
        return fit([np.zeros(0, np.uint32)] * n, np.full(n, float(bool(ones))))
    counts = held.where("not back").select(F.explode("terms").alias("term"), "label").groupBy("term").agg(F.count(F.lit(1)).alias("texts"), F.sum("label").alias("ones"))
    part = lambda x, due: F.when(x > 0, 2 * x * F.ln(x / due)).otherwise(0)
    cell = lambda seen, one: part(one, seen * ones / n) + part(seen - one, seen * (n - ones) / n)
    often = F.col("texts") >= max(LEAST_TEXTS, PAIR_SHARE * n)
    alone = (F.col("texts") >= LEAST_TEXTS) & (cell(F.col("texts"), F.col("ones")) + cell(n - F.col("texts"), ones - F.col("ones")) >= LEAST_RATIO)
    table = counts.where(often | alone).select("term", often.alias("often"), alone.alias("alone")).toArrow()
    terms, often_, alone_ = (table[c].to_numpy() for c in ("term", "often", "alone"))
    wanted = held.sparkSession.sparkContext.broadcast(np.sort(terms).astype(np.uint32))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.intersect1d(np.array(x, np.uint32), wanted.value, assume_unique=True).tobytes() for x in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["id", "label", "back", "terms"])

    got = sorted((r["id"], r["label"], r["back"], bytes(r["terms"])) for r in map_batches(held, work, "id long, label int, back boolean, terms binary").toLocalIterator())
    found, y = [np.frombuffer(t, np.uint32) for *_, t in got], np.array([v for _, v, _, _ in got], np.float64)
    front = [k for k, g in enumerate(got) if not g[2]]
    pairs = np.sort(terms[often_]).astype(np.uint32)
    pairs = pairs[paired(pairs, [found[k] for k in front], y[front])] if len(pairs) else pairs
    # fit holds every fifth text back, so texts are put where it looks for them.
    order = iter(front), iter([k for k, g in enumerate(got) if g[2]])
    at = [k for i in range(len(got)) if (k := next(order[i % 5 == 4], None)) is not None]
    return fit([found[k] for k in at], y[at], kept=np.union1d(terms[alone_].astype(np.uint32), pairs))


def score_documents(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with a score (0 to 1) of each whole text and 1 where it reaches the threshold, else 0.

    Null, empty and unknown texts get the score of a text without known terms. Columns of docs that have the
    new names are replaced. Repeated rows are kept; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    rest = [c for c in docs.columns if c not in (score_col, predicted_col)]
    schema = docs.select(*rest).schema.add(score_col, "double").add(predicted_col, "integer")
    at = rest.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = scores(held.value, [terms_of(x) for x in batch.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*rest, score_col, predicted_col])

    return map_batches(docs.select(*rest), work, schema)
