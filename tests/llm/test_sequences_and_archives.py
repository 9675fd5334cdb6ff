import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import fmod

import duckdb
import numpy as np
import pytest
from conftest import DATA

from tidemark.llm import queries, ranked, rows, trie, warc


def slow_nodes(turns):
    """Nodes of the rebuilt conversations, by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], text))
    whole = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, sorted(own.get(c - int(fmod(c, 100)), []))
        whole[c] = tuple((v[2], v[4]) for v in base[:h] + sorted(own[c])[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def odd_turns():
    rng = random.Random(3)
    out = [(None, 1, "user", "no conversation"), (7, None, None, None), (7, None, None, None)]
    for c in [*range(-5, 30), 100, 101, 103, 206, 301, 399]:
        out += [(c, rng.choice([t, t, None]), rng.choice(["user", None, "a"]), rng.choice(["x", "héy🙂", None, "", "long " * 9])) for t in range(rng.choice([0, 1, 2, 6, 12]))]
    out += [(500 + k, t, "u", f"same {t}") for k in range(60) for t in range(20)]  # a group of copies
    return out + [(700, t, "u", str(t % 3)) for t in range(400)] + [(700, 5, "u", "2")] * 3  # a long conversation with repeated rows


@pytest.mark.parametrize("shard", [20_000, 300, 20])
def test_trie_is_brute_force_with_and_without_heavy_levels(spark, shard):
    made = odd_turns()
    turns = spark.createDataFrame([(*r, 1) for r in made], "conv_id long, turn long, role string, text string, pos int").repartition(3)
    assert sorted(map(tuple, trie.nodes(turns, shard=shard).collect())) == slow_nodes(made)


def test_trie_of_nothing(spark):
    assert trie.nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_louds_walks_and_rolls_up():
    # 0 above two roots; a has b and c, c has d.
    f = trie.Louds(np.array([2, 0, 1, 1, 0]), ["d", "a", "b", "c", "e"], ["c", "?", "a", "a", "?"])
    names = np.array(["d", "a", "b", "c", "e"])[f.order].tolist()
    assert names[:2] == ["a", "e"] and set(names[2:4]) == {"b", "c"} and names[4] == "d"
    assert f.parents().tolist() == [0, 0, 1, 1, 1 + names.index("c")] and f.degrees().sum() == 5
    assert f.rolled_up(np.array([0, 1, 1, 1, 1, 1])).tolist()[:3] == [5, 4, 1]


@pytest.mark.parametrize("name", ["op11_prefixtrie", "op12_warc", "op13_ranked"])
def test_queries_are_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    other = duck.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, f"{DATA}/sf0.001").select(*other.columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(other.fetchall(), key=str)


PAGES = [(3, "http://a/b c\r\nX: y", "same"), (1, None, "same"), (2, "http://ü", "same"), (None, "http://n", "same"), (4, "u", ""), (5, "u", None), (6, "v", "é" * 300_000), (7, "w", "tie"), (7, "w", "tie"), (7, "x", "tie"), (None, None, "alone"), (8, "d", "\r\n\r\n<p>\r\n\r\n")]


@pytest.fixture(scope="module")
def folder(spark):
    rows.prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/archives"


def test_archives_give_back_what_was_written(spark, folder):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(5)
    warc.write(pages, f"{folder}/odd", roll_bytes=400, shard_bytes=1500)
    got = warc.read(spark, f"{folder}/odd", html=True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((h or "").encode()), warc.base32(hashlib.sha1((h or "").encode()).digest())) for i, _, h in PAGES)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter([(1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1), (4, "response", None), (5, "revisit", 4), (6, "response", None), (7, "response", None), (7, "revisit", 7), (7, "revisit", 7), (None, "response", None), (8, "response", None)])
    assert {(r.page_id, r.html) for r in got if r.record_type == "response"} == {(1, "same"), (4, ""), (6, "é" * 300_000), (7, "tie"), (None, "alone"), (8, "\r\n\r\n<p>\r\n\r\n")}


def test_archives_are_deterministic_and_roll(spark, folder):
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    made = [sorted(map(tuple, warc.write(pages.repartition(n), f"{folder}/same{n}", shard_bytes=40_000, roll_bytes=6_000).collect())) for n in (2, 5)]
    assert made[0] == made[1] and len({m[0] for m in made[0]}) > 2 and len(made[0]) > len({m[0] for m in made[0]})
    store, root = warc.opened(f"{folder}/same2")
    with store.open_input_stream(f"{root}/{made[0][0][1]}", compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert warc.read(spark, f"{folder}/same2").count() == pages.count()


def test_least_bytes_and_empty_archives(spark, folder):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write(pages, f"{folder}/least", least_bytes=3)
    assert {(r.page_id, r.record_type) for r in warc.read(spark, f"{folder}/least").collect()} == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}
    warc.write(pages.limit(0), f"{folder}/none")
    assert warc.read(spark, f"{folder}/none").count() == 0


def test_damage_is_an_error(spark, folder):
    warc.write(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"), f"{folder}/bad")
    store, root = warc.opened(f"{folder}/bad")
    name = warc.manifest(spark, f"{folder}/bad").first().file
    with store.open_input_stream(f"{root}/{name}", compression=None) as f:
        text = gzip.decompress(f.read()).replace(b"payload", b"PAYLOAD")
    with store.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(gzip.compress(text))
    with pytest.raises(Exception, match="digest|length|manifest|wrong"):
        warc.read(spark, f"{folder}/bad").collect()


def slow_ranking(docs, items, places):
    terms = {k: list(ranked.term_counts(t).elements()) for k, (_, t) in enumerate(docs)}
    n_docs, n_all = sum(bool(t) for t in terms.values()), sum(map(len, terms.values()))
    counts = {k: Counter(t) for k, t in terms.items()}
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for k, (doc, _) in enumerate(docs):
            m = 75 + 25 * len(terms[k]) * n_docs // n_all if n_all else 0
            score = sum(n * ranked.weight(n_docs, df[t]) * (1_000_000_000 * counts[k][t] // (1000 * counts[k][t] + 12 * m)) for t, n in ranked.term_counts(text).items() if counts[k][t])
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:places], 1)]
    return sorted(out, key=str)


def test_ranking_is_brute_force_over_ties_and_shards(spark, monkeypatch):
    monkeypatch.setattr(ranked, "LEAF", 2)
    monkeypatch.setattr(ranked, "LEAVES", 4)
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "ÉTÉ", "été", "x1", "_", "tide", "mark", "über"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 30])))) for k in range(60)]
    docs += [(100 + k, "tide mark tide") for k in range(40)] + [(150, "tide mark tide")] * 2 + [(None, "tide mark"), (200, None), (201, ""), (202, "tide " * 40_000)]
    items = [(1, "tide"), (1, "mark tide tide"), (2, None), (3, ""), (4, "nowhere"), (5, "BETA été x1_über"), (6, "tide"), (6, "tide"), (None, "alpha")]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, score int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for places in (1, 7):
        got = sorted((tuple(r) for r in ranked.best_documents(frame, bench, places).collect()), key=str)
        assert got == slow_ranking(docs, items, places)
    assert ranked.best_documents(frame.limit(0), bench).count() == 0 and ranked.best_documents(frame, bench.limit(0)).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 4)
    docs = [(k, f"w{k} w{k + 1} common") for k in range(20)]
    items = [(k, f"w{k} common") for k in range(10)]
    held = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(ranked.item_blocks(held.withColumnRenamed("item_id", "item")))) > 1
    got = sorted((tuple(r) for r in ranked.best_documents(spark.createDataFrame(docs, "doc_id long, text string"), held, 5).collect()), key=str)
    assert got == slow_ranking(docs, items, 5)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(ranked, "PIECE", 7)
    assert [t for run in ranked.term_runs("Ab,cd efghijklmno p  QR") for t in run] == [b"ab", b"cd", b"efghijklmno", b"p", b"qr"]
