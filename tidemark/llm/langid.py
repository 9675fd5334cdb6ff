"""Language identification by interpolated Kneser-Ney character models kept in sorted hash arrays.

Each language has a model of five letters' length: the highest order counts n-grams, lower orders count the distinct letters
that precede them, and each order gives the next lower one the mass that it discounts. The models of all languages lie side by
side in one array per order: sorted 64-bit hashes of the n-grams that any language has, with a row of log-probabilities
(and one of log-weights for contexts), so one search serves all languages. A text gets the language whose cross-entropy per
letter is least. Spark counts the n-grams of the training texts, and the driver gets the counts. A text is rejected where that cross-entropy lies above what nearly all of the language's own held-back
training texts have, or where it has no letter.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.rows import map_batches, prepare, stored

ORDER = 5
#: Bounds of the training sample: about so many whole texts of each language, chosen by a hash of the id, and the most frequent languages.
SAMPLE_ROWS = 1000
MOST_LANGUAGES = 200
UNKNOWN = "und"
#: Letters are numbered by frequency up to here, so that BITS hold a number; rarer ones share the last number.
LETTERS, BITS = 4000, 12
#: Letters that a batch is scored in.
CHUNK = 1 << 21
#: A hash of a number (splitmix64).
MIX = tuple(np.array(x, np.uint64) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Model(NamedTuple):
    langs: list[str]
    number: np.ndarray  # of each code point below 65,536: 0 no letter, then by frequency
    keys: list[np.ndarray]  # by order from 1: sorted hashes of n-grams
    logp: list[np.ndarray]  # a row per key, a column per language
    ctx_keys: list[np.ndarray]  # by length from 1: sorted hashes of contexts
    ctx_logw: list[np.ndarray]
    floor: np.ndarray  # log-probability of a letter never seen
    limit: np.ndarray  # cross-entropy above which a language rejects
    sharpness: float  # of the score


def mixed(codes: np.ndarray) -> np.ndarray:
    x = codes + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def letters_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(65536)])


ALPHA = letters_table()


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each with a blank at both ends, and where each text starts."""
    joined = "".join([f" {t.lower()} " for t in texts])
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) + 2 for t in texts], np.int64)
    return flat, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def numbered(flat: np.ndarray, starts: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters' numbers with one 0 for each run of other signs, and where each text starts among them."""
    low = flat < 65536
    out = number[np.where(low, flat, 0)]
    if not low.all():
        out[~low] = [LETTERS if chr(c).isalpha() else 0 for c in flat[~low]]
    keep = out > 0
    keep[1:] |= out[:-1] > 0
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return out[keep].astype(np.uint64), place[starts]


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Code of the n-gram that ends at each place from n - 1 on, BITS bits a letter."""
    code = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        code = (code << np.uint64(BITS)) | ids[k : len(ids) - n + 1 + k]
    return code


def counted(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of ORDER letters of texts, with blanks before each text, and how often they come."""
    ends = np.append(starts[1:], len(ids))
    lead = np.zeros(ORDER - 1, np.uint64)
    return np.unique(np.concatenate([grams(np.concatenate([lead, ids[a:b]]), ORDER) for a, b in zip(starts, ends, strict=True)]), return_counts=True)


def kneser_ney(codes: np.ndarray, n_seen: np.ndarray) -> tuple[list[dict], float]:
    """Per order from 1 (codes, probabilities, contexts, weights), of one language's n-grams of ORDER letters, sorted, and their counts."""
    counts, longer = [(codes, n_seen)], codes
    for n in range(ORDER - 1, 0, -1):
        # How many distinct letters precede each n-gram: its left extensions among the (n + 1)-grams.
        shorter, kinds = np.unique(longer & np.uint64((1 << (BITS * n)) - 1), return_counts=True)
        counts.insert(0, (shorter, kinds))
        longer = shorter
    out: list[dict] = []
    uniform = 1.0 / (LETTERS + 1)
    for n, (codes, c) in enumerate(counts, 1):
        once, twice = (c == 1).sum(), (c == 2).sum()
        d = once / (once + 2 * twice) if once and twice else 0.5
        context = codes >> np.uint64(BITS)
        ctx, where = np.unique(context, return_inverse=True)
        total = np.bincount(where, c)
        kinds = np.bincount(where)
        weight = d * kinds / total
        if n == 1:
            lower = np.full(len(codes), uniform)
        else:
            prior = out[-1]
            suffix = codes & np.uint64((1 << (BITS * (n - 1))) - 1)
            lower = prior["p"][np.searchsorted(prior["codes"], suffix)]
        out.append({"codes": codes, "p": np.maximum(c - d, 0) / total[where] + weight[where] * lower, "ctx": ctx, "w": weight})
    return out, uniform


def _log_probabilities(model: list[dict], uniform: float, codes: np.ndarray, n: int) -> np.ndarray:
    """Probability of the last letter of any codes of order n by one language's model."""
    if n == 0:
        return np.full(len(codes), uniform)
    own = model[n - 1]
    at = np.minimum(np.searchsorted(own["codes"], codes), len(own["codes"]) - 1)
    hit = own["codes"][at] == codes
    out = own["p"][at].copy()
    miss = codes[~hit]
    if len(miss):
        ctx = miss >> np.uint64(BITS)
        c = np.minimum(np.searchsorted(own["ctx"], ctx), len(own["ctx"]) - 1)
        weight = np.where(own["ctx"][c] == ctx, own["w"][c], 1.0)
        out[~hit] = weight * _log_probabilities(model, uniform, miss & np.uint64((1 << (BITS * (n - 1))) - 1), n - 1)
    return out


def numbers(points_: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for each code point below 65,536, from counts of code points; ties go to the lower one."""
    seen = np.zeros(65536, np.int64)
    np.add.at(seen, points_[points_ < 65536], counts[points_ < 65536])
    number = np.where(ALPHA, LETTERS, 0).astype(np.uint16)
    frequent = [c for c in np.argsort(-seen, kind="stable")[: 2 * LETTERS] if ALPHA[c] and seen[c]][: LETTERS - 1]
    number[frequent] = np.arange(1, len(frequent) + 1)
    return number


def fit(texts: dict[str, list[str]]) -> Model | None:
    """A model of the languages' texts at hand; every tenth text is held back to calibrate rejection and score."""
    texts = {lang: [t for t in own if any(map(str.isalpha, t))] for lang, own in texts.items()}
    langs = sorted(lang for lang, own in texts.items() if own)[:MOST_LANGUAGES]
    if not langs:
        return None
    kept = {lang: [t for k, t in enumerate(texts[lang]) if k % 10 or len(texts[lang]) < 10] for lang in langs}
    back = {lang: [t for k, t in enumerate(texts[lang]) if not k % 10] for lang in langs}
    number = numbers(*np.unique(np.concatenate([points(kept[lang])[0] for lang in langs]), return_counts=True))
    model = assembled({lang: counted(*numbered(*points(kept[lang]), number)) for lang in langs}, number)
    return calibrated(model, {lang: back[lang] or kept[lang] for lang in langs})


def assembled(counts: dict[str, tuple[np.ndarray, np.ndarray]], number: np.ndarray) -> Model:
    """The languages' models side by side, from each one's n-grams and their counts; not calibrated yet."""
    langs = sorted(counts)
    models = {lang: kneser_ney(*counts[lang]) for lang in langs}
    keys, logp, ctx_keys, ctx_logw = [], [], [], []
    for n in range(1, ORDER + 1):
        codes = np.unique(np.concatenate([models[lang][0][n - 1]["codes"] for lang in langs]))
        rows = np.stack([np.log(_log_probabilities(*models[lang], codes, n)) for lang in langs], axis=1)
        order = np.argsort(hashes := mixed(codes + np.uint64(n << 60)))
        keys.append(hashes[order])
        logp.append(rows[order].astype(np.float32))
        ctx = np.unique(np.concatenate([models[lang][0][n - 1]["ctx"] for lang in langs]))
        weights = []
        for lang in langs:
            own = models[lang][0][n - 1]
            at = np.minimum(np.searchsorted(own["ctx"], ctx), len(own["ctx"]) - 1)
            weights.append(np.log(np.where(own["ctx"][at] == ctx, own["w"][at], 1.0)))
        order = np.argsort(hashes := mixed(ctx + np.uint64(n << 60)))
        ctx_keys.append(hashes[order])
        ctx_logw.append(np.stack(weights, axis=1)[order].astype(np.float32))
    floor = np.full(len(langs), np.log(1.0 / (LETTERS + 1)), np.float32)
    return Model(langs, number, keys, logp, ctx_keys, ctx_logw, floor, np.full(len(langs), np.inf), 1.0)


def calibrated(model: Model, texts: dict[str, list[str]]) -> Model:
    return limited(model, {lang: cross_entropies(model, own) for lang, own in texts.items()})


def limited(model: Model, scored: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Rejection limits from held-back texts: the mean cross-entropy of the language's own plus six deviations."""
    limit, own, other = [], [], []
    for k, lang in enumerate(model.langs):
        h, n = scored[lang]
        h = h[n >= 20] if (n >= 20).any() else h[n > 0]
        limit.append(float(h[:, k].mean() + 6 * h[:, k].std() + 0.1) if len(h) else np.inf)
        if len(model.langs) > 1 and len(h):
            own.append(h[:, k])
            other.append(np.delete(h, k, axis=1).min(axis=1))
    # The sharpness makes the mean score of a held-back text near the share of right answers, and not above 0.99.
    gaps = np.concatenate(other) - np.concatenate(own) if own else np.ones(1)
    target = min(0.99, max(0.5, float((gaps > 0).mean())))
    low, high = 0.01, 1000.0
    for _ in range(40):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if float((1 / (1 + np.exp(-np.clip(mid * gaps, -60, 60)))).mean()) < target else (low, mid)
    return model._replace(limit=np.array(limit), sharpness=high)


def _search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _letters_logp(model: Model, codes: np.ndarray, n: int) -> np.ndarray:
    """Log-probability of each code's last letter by each language; what no language has falls back to shorter ones."""
    if n == 0:
        return np.broadcast_to(model.floor, (len(codes), len(model.langs)))
    at, hit = _search(model.keys[n - 1], mixed(codes + np.uint64(n << 60)))
    out = model.logp[n - 1][at]
    if not hit.all():
        miss = codes[~hit]
        c, known = _search(model.ctx_keys[n - 1], mixed((miss >> np.uint64(BITS)) + np.uint64(n << 60)))
        out[~hit] = np.where(known[:, None], model.ctx_logw[n - 1][c], 0) + _letters_logp(model, miss & np.uint64((1 << (BITS * (n - 1))) - 1), n - 1)
    return out


def cross_entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per letter by language, letters scored) of each whole text."""
    total, n = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        _score(model, texts, at, end, total, n)
        at = end
    return -total / np.maximum(n, 1)[:, None], n


def _score(model: Model, texts: list[str], start: int, end: int, total: np.ndarray, n: np.ndarray) -> None:
    ids, starts = numbered(*points(texts[start:end]), model.number)
    ends = np.append(starts[1:], len(ids))
    lead = np.zeros(ORDER - 1, np.uint64)
    codes = grams(np.concatenate([lead, ids]), ORDER)
    owner = np.repeat(np.arange(start, end), ends - starts)
    scored = np.ones(len(ids), bool)
    scored[starts] = False  # the blank before the first letter
    # The first letters of a text see no letters of the text before it.
    for k in range(1, ORDER - 1):
        places = starts[(ends - starts) > k] + k
        codes[places] &= np.uint64((1 << (BITS * (k + 1))) - 1)
    for a in range(0, len(codes), CHUNK):
        b = min(len(codes), a + CHUNK)
        use = scored[a:b]
        mine = owner[a:b][use]
        found = _letters_logp(model, codes[a:b][use], ORDER)
        if len(mine):
            first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            total[mine[first]] += np.add.reduceat(found, first, axis=0, dtype=np.float64)
            n[mine[first]] += np.diff(np.append(first, len(mine)))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, cross-entropy, accepted) of each text; texts without a letter get `und`, 0, 0 and False."""
    letters = [t is not None and any(map(str.isalpha, t)) for t in texts]
    names, score, least, accepted = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
    some = np.flatnonzero(letters)
    if model is not None and len(some):
        h, _ = cross_entropies(model, [texts[i] for i in some])
        best = h.argmin(axis=1)
        least[some] = h[np.arange(len(some)), best]
        weight = np.exp(-np.clip(model.sharpness * (h - least[some][:, None]), 0, 60))
        score[some] = 1 / weight.sum(axis=1)
        accepted[some] = least[some] <= model.limit[best]
        for i, b in zip(some, best, strict=True):
            names[i] = model.langs[b]
    return names, score, least, accepted


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """(lang, back, text), stored: about `rows` whole texts of each language, by a hash of the id; back: one in ten, held back."""
    named = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("langid"), id_col).alias("h"))
    counts = named.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.1 * rows / r["n"])))])
    few = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(r["n"] < 30))])
    chosen = named.where(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    back = F.when(F.element_at(few, F.col("lang")), F.lit(None).cast("boolean")).otherwise(F.pmod(F.shiftright("h", 20), F.lit(10)) == 0)
    return stored(chosen.select("lang", back.alias("back"), "text"), "langid")


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, accepted) for each row of docs, from its whole text alone.

    A null text, an empty one and one without a letter get `und`, score 0 and no acceptance; so does every text if
    there was nothing to learn from. accepted is false for texts unlike the training texts of the language found. Equal
    cross-entropies go to the first language by name. Repeated rows and null ids are returned as they come; other
    columns are not read; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, h, ok = predict(held.value, batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(score), pa.array(h), pa.array(ok)], names=["id", "lang_pred", "score", "cross_entropy", "accepted"])

    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(frame, work, "id long, lang_pred string, score double, cross_entropy double, accepted boolean")


def trained(spark: SparkSession, docs: DataFrame) -> Model | None:
    """A model of the sample of docs. Letters and n-grams are counted by Spark; the driver gets counts, no texts.

    Of a language with fewer than 30 texts (back is null) all are learned from and calibrate too.
    """
    prepare(spark)
    held = sample(docs)
    if held is None:
        return None
    front, back = held.where("not coalesce(back, false)"), held.where("coalesce(back, true)")

    def letters(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, n = np.unique(points(batch.column(2).to_pylist())[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["point", "n"])

    table = map_batches(front, letters, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy("point").toArrow()
    number = numbers(table["point"].to_numpy(), table["n"].to_numpy())
    given = spark.sparkContext.broadcast(number)

    def ngrams(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(2).to_pylist()
        out = []
        for lang in sorted(set(langs)):
            codes, n = counted(*numbered(*points([texts[i] for i in np.flatnonzero(langs == lang)]), given.value))
            out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    grams_ = map_batches(front, ngrams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).orderBy("lang", "code").toArrow()
    lang = grams_["lang"].to_numpy()
    cuts = np.flatnonzero(np.append(True, lang[1:] != lang[:-1])) if len(lang) else np.zeros(0, int)
    codes, n = grams_["code"].to_numpy().view(np.uint64), grams_["n"].to_numpy()
    counts = {str(lang[a]): (codes[a:b], n[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(lang)), strict=True)}
    if not counts:
        return None
    model = assembled(counts, number)
    ready = spark.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, letters_ = cross_entropies(ready.value, batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(letters_)], names=["lang", "h", "n"])

    rows = sorted((r["lang"], list(r["h"]), r["n"]) for r in map_batches(back, scored, "lang string, h array<double>, n long").where("n > 0").toLocalIterator())
    of = {name: [(h, k) for own, h, k in rows if own == name] for name in model.langs}
    return limited(model, {name: (np.array([h for h, _ in own]).reshape(-1, len(model.langs)), np.array([k for _, k in own], np.int64)) for name, own in of.items()})
