import numpy as np
import xxhash
from llm_helpers import roots

from tidemark.llm import components, linededup, links, simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_are_brute_force(docs):
    held = docs.select("doc_id", "text").collect()
    found = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    fp = np.array([slow_fingerprint(r.text) for r in held], np.uint64)
    assert [np.array(found[r.doc_id].fp).astype(np.int64).view(np.uint64) for r in held] == list(fp)
    ids = np.array([r.doc_id for r in held])
    near = [(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3)]
    own = roots(len(fp), near)
    for i, r in enumerate(held):
        assert found[r.doc_id].component_id == min(ids[[k for k, x in enumerate(own) if x == own[i]]])


def test_links_are_complete_around_a_centre(spark):
    """Values within 3 bits of others, and a crowded bucket of more than a block."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False)) for b in base for _ in range(4)]
    crowd = [int(base[0]) ^ (i << 40) for i in range(1200)]
    values = np.array(sorted({*map(int, base), *near, *crowd}), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    edges = [tuple(np.array([r.a, r.b], np.int64).view(np.uint64)) for r in simhash.links(frame).collect()]
    assert all(np.bitwise_count(a ^ b) <= 3 for a, b in edges)
    at = {int(v): i for i, v in enumerate(values)}
    want = [(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3)]
    assert roots(len(values), [(at[int(a)], at[int(b)]) for a, b in edges]) == roots(len(values), want)
    assert len(edges) < 9 * len(values)  # not all pairs


def test_components_of_chains_stars_and_repeats(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 400)] + [(7, 7), (500, 501), (501, 500), (500, 501)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got[60] == 1 and got[399] == 100 and got[501] == 500 and len(got) == 60 + 300 + 2
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.fp == 0} == {3} and {r.component_id for r in rows if r.id in (1, 2)} == {1}
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 6, 7, 8]
    assert simhash.near_duplicates(none).count() == 0 and simhash.representatives(none).count() == 0


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_and_bound():
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("abcd "), rng.integers(0, 15))) for _ in range(80)]
    may = linededup.possible(lines, 0.8)
    for i, a in enumerate(lines):
        ok = may(i, np.arange(len(lines)))
        for j, b in enumerate(lines):
            d = slow_distance(a, b)
            assert linededup.distance(a, b, 99) == d
            assert linededup.alike(a, b) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))
            assert ok[j] or not linededup.alike(a, b)


def test_fuzzy_lines_and_odd_rows(spark, odd, none):
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"{line}\nfirst"), (2, f"{line.upper()}\nsecond"), (3, f"  {line}  \nthird\nthird"), (4, None)]
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"{line}\nfirst", 2: "second", 3: "third", 4: None}
    out = linededup.dedup(odd, removed_col="fp").collect()
    assert len(out) == odd.count()
    texts = {(r.doc_id, r.text) for r in out if r.doc_id in (1, 2)}
    assert texts == {(1, "The same line here.\nAnother line of words"), (2, "")}
    assert linededup.dedup(none).count() == 0


def test_search_connects_what_agrees():
    values = np.array([0, 0, 0, 7, 255], np.uint64)
    near = lambda i, js: np.bitwise_count(values[js] ^ values[i]) <= 3
    assert links.forest(5, near) == [(0, 1), (0, 2), (0, 3)]
    assert links.forest(5, near, lambda i, j: abs(i - j) == 1) == [(0, 1), (1, 2), (2, 3)]
    assert links.bridges(["a", "a", "b", "b", "c"], np.array([0, 0, 1, 1, 1], bool), near) == [(2, 0)]


def test_crowded_buckets_lose_no_link(spark):
    """Blocks of 16 in a bucket of 500 nodes: a tight group, chains and lone nodes, against brute force."""
    rng = np.random.default_rng(5)
    tight = [1 << 60 | int(x) << 40 for x in rng.integers(0, 64, 300)]
    chain = [sum(1 << k for k in range(n)) for n in range(0, 40, 2)]
    values = np.array(sorted({*tight, *chain, *map(int, rng.integers(0, 1 << 40, 150))}), np.uint64)
    rows = spark.createDataFrame([(1, int(x)) for x in values.view(np.int64)] + [(2, 5)], "k long, node long")
    for most in (2, 3):
        got = [tuple(np.array([r.a, r.b], np.int64).view(np.uint64)) for r in links.linked(rows, ["k"], simhash._pairs(most), simhash._test(most), block=16).collect()]
        at = {int(v): i for i, v in enumerate(values)}
        want = [(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= most)]
        assert all(np.bitwise_count(a ^ b) <= most for a, b in got) and len(got) < 4 * len(values)
        assert roots(len(values), [(at[int(a)], at[int(b)]) for a, b in got]) == roots(len(values), want)


def test_certain_is_an_upper_bound():
    rng = np.random.default_rng(6)
    words = ["aa", "b", "ccc", "dd", "eeee"]
    yes = 0
    for _ in range(400):
        a = [words[k] for k in rng.integers(0, 5, rng.integers(1, 12))]
        b = list(a)
        for _ in range(rng.integers(0, 3)):
            k = rng.integers(0, len(b) + 1)
            b[k : k + rng.integers(0, 2)] = [words[rng.integers(0, 5)]] * rng.integers(0, 2)
        a, b = " ".join(a), " ".join(b)
        d = slow_distance(a, b)
        for most in (d - 1, d, d + 2):
            if most >= 0:
                assert not linededup.certain(a, b, most) or d <= most
                yes += linededup.certain(a, b, most)
    assert yes > 300


def test_lines_with_changed_words_go(spark, docs):
    """Brute force over edit similarity alone: of the lines that have an alike one, nine in ten are found."""
    from tidemark.llm.queries import queries

    first = {}
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        for line in (r.text or "").split("\n"):
            first.setdefault(linededup.normalised(line).decode(), r.doc_id)
    held = sorted((x for x in first if x), key=len)
    may, size = linededup.possible(held, 0.8), np.array([len(x) for x in held])
    pairs = []
    for i in range(len(held)):
        js = np.arange(i + 1, np.searchsorted(size, size[i] / 0.8 + 1, "right"))
        pairs += [(i, int(j)) for j in js[may(i, js)] if linededup.alike(held[i], held[int(j)])] if len(js) else []
    assert len(pairs) > 30
    want = sum(a != b for a, b in enumerate(roots(len(held), pairs)))
    kept = {linededup.normalised(x).decode() for r in queries()["op6_linededup"](spark, "/root/testdata/sf0.001").collect() for x in (r.text or "").split("\n")}
    gone = sum(x not in kept for x in held)
    assert 0.9 * want <= gone <= want, (gone, want)


def test_one_changed_letter(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    rows = []
    for i in range(300):
        words = [word() for _ in range(rng.integers(5, 60))]
        rows.append((i, " ".join(words)))
        k = rng.integers(len(words))
        words[k] = words[k][:-1] + "z"
        rows.append((1000 + i, " ".join(words)))
    out = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.text == "" for r in out if r.doc_id >= 1000) >= 270 and all(r.text for r in out if r.doc_id < 1000)


def test_many_distances_at_once():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a = "".join(rng.choice(list("abcd é"), rng.integers(1, 70)))
        others = ["".join(rng.choice(list("abcd é"), rng.integers(1, 70))) for _ in range(3)] + [a, a[::2] or a, a[: len(a) // 2] + "x" + a[len(a) // 2 :]]
        codes = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (a, *others)]
        assert linededup.distances(codes[0], codes[1:]).tolist() == [slow_distance(a, b) for b in others]


def test_wider_looks_join_what_one_look_joins():
    at = np.random.default_rng(6).integers(0, 400, 80)
    agree = lambda i, js: abs(at[js] - at[i]) <= 4
    nears = [lambda i, js, most=most: abs(at[js] - at[i]) <= most for most in (2, 3, 9)]
    trees = lambda edges: sorted(sorted(x) for x in _trees(80, edges))
    assert trees(links.forest(80, nears[0], agree, nears[1:])) == trees(links.forest(80, nears[2], agree))


def _trees(n, edges):
    own = list(range(n))
    for a, b in edges:
        own = [own[b] if x == own[a] else x for x in own]
    return [[i for i in range(n) if own[i] == r] for r in set(own)]


def test_components_copy_hot_nodes_only(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES", 1000)
    star = spark.range(1, 20_001).selectExpr("id as a", "0L as b")
    groups = spark.range(30_000).selectExpr("100000 + id as a", "100000 + id - id % 3 as b").where("a <> b")
    edges = star.union(groups)
    got = {r.node: r.root for r in components.connected(edges).collect()}
    assert len(got) == 20_001 + 30_000 and all(got[n] == (0 if n < 100_000 else n - (n - 100_000) % 3) for n in got)
    both = edges.selectExpr("a as u", "b as v").union(edges.selectExpr("b as u", "a as v"))
    hot = components._hot(both, both.count())
    assert [(r.u, r.k) for r in hot.collect()] == [(0, 20)]
    assert components._lowest(both, hot).count() == both.count() and components._hot(groups.selectExpr("a as u", "b as v"), 20_000) is None


def test_lines_of_a_text_are_those_of_each_line():
    for text in ("A\tb  c\r\n x \n\n  \nΑΣ\nΣΑΣ b", "İx y\x1cz\n\x0b\x0cq", " ", "\n", "ab ", "", None, "ΑΣ.\nΑ", "a b\nc d"):
        assert linededup.normalised_lines(text) == [linededup.normalised(x) for x in (text or "").split("\n")]


def test_many_pairs_at_once():
    rng = np.random.default_rng(8)
    pairs, most, want = [], [], []
    for k in range(250):
        a = rng.choice(list("abcd é"), rng.integers(0, 400 if k < 20 else 150)).tolist()
        b = list(a) if k % 5 else rng.choice(list("abcd é"), len(a)).tolist()
        for _ in range(rng.integers(0, 40)):
            at = rng.integers(0, len(b) + 1)
            b[at : at + rng.integers(0, 2)] = rng.choice(list("abcdz "), rng.integers(0, 2)).tolist()
        most.append(int(0.2 * max(len(a), len(b))))
        want.append(linededup.distance("".join(a), "".join(b), most[-1]) <= most[-1])
        pairs.append(tuple(np.frombuffer("".join(x).encode("utf-32-le"), np.uint32) for x in (a, b)))
    assert linededup.within(pairs, np.array(most)).tolist() == want and 50 < sum(want) < 200


def test_pairs_of_many_buckets_connect_what_is_alike():
    rng = np.random.default_rng(9)
    kind = linededup.KINDS[1]
    lines = []
    for i in range(60):
        base = "".join(rng.choice(list("abcdefgh "), 60)).strip()
        lines += [base] + [base[:k] + "z" * int(rng.integers(1, 18)) + base[k + 3 :] for k in rng.integers(0, 50, int(rng.integers(0, 5)))]
    lines = [" ".join(x.split()) for x in lines]
    sketch, keys = linededup.features([x.encode() for x in lines], kind)
    rows, bucket = {c: [] for c in ("kind", "j", "key", "node", "line", "sketch", "keys")}, []
    short = (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)
    groups = [np.flatnonzero(short[:, j] == key) for j in range(kind.bands) for key in np.unique(short[:, j])]
    want = set()
    for number, group in enumerate(g for g in groups if len(g) > 1):
        near = [(int(a), int(b)) for a in group for b in group if a < b and (int(sketch[a]) ^ int(sketch[b])).bit_count() <= kind.bits]
        want |= {p for p in near if linededup.alike(lines[p[0]], lines[p[1]])}
        j = next(j for j in range(kind.bands) if len(set(short[group, j])) == 1)
        for i in group:
            bucket.append(number)
            for c, v in (("kind", 1), ("j", 0), ("key", j), ("node", f"{i:03}"), ("line", lines[i].encode()), ("sketch", sketch[i].astype(np.int64)), ("keys", short[i])):
                rows[c].append(v)
    cols = {c: v if c in ("node", "line", "keys") else np.array(v) for c, v in rows.items()}
    got = [(int(a), int(b)) for a, b in linededup._paired(0.8)(cols, np.array(bucket))]
    assert roots(len(lines), got) == roots(len(lines), list(want)) and len(want) > len(got) > 40


def test_keys_go_packed_and_crowded_ones_are_dealt_out(spark):
    rng = np.random.default_rng(10)
    posts = rng.integers(-(1 << 62), 1 << 62, (3000, 3))
    posts[:1000, 0] = 5
    found = [row for batch in linededup._packed(posts, 1024) for row in batch.to_pylist()]
    held = [tuple(x) for r in found for x in np.frombuffer(r["posts"], np.int64).reshape(-1, 3).tolist()]
    assert sorted(held) == sorted(map(tuple, posts.tolist()))
    of = lambda r: 5 in np.frombuffer(r["crowd"], np.int64)
    dealt = [r for r in found if any(x[0] == 5 for x in np.frombuffer(r["posts"], np.int64).reshape(-1, 3))]
    assert len({r["bucket"] for r in dealt}) > 300 and all(map(of, dealt))
    assert {r["bucket"] for r in found if of(r) and not r["posts"]} == {0}  # the bucket of the least keys
    lines = spark.createDataFrame([("\n".join(f"{a} word of the line {a * 7919 + k} and more {k}" for k in range(200)),) for a in range(20)], "text string")
    packed = linededup._posts(lines.coalesce(1), 1024)
    assert packed.count() <= 4 * 1024 and packed.selectExpr("sum(length(posts) / 24)").first()[0] >= 4000 * 8


def test_pairs_are_compared_on_the_diagonals_that_their_edits_can_reach(monkeypatch):
    """A pair had a bit for each letter of its line; now for each of most + 1 diagonals, whole words of 64 with and without a bit left."""
    rng = np.random.default_rng(11)
    given, compare = [], linededup._banded
    monkeypatch.setattr(linededup, "_banded", lambda pairs, size, most: given.append(int(size.sum())) or compare(pairs, size, most))
    pairs, most, want = [], [], []
    for k in range(120):
        a = rng.choice(list("abcdeé ыñ"), rng.integers(500, 900))
        b = a.copy()
        for _ in range(rng.integers(0, 100)):
            at = int(rng.integers(0, len(b)))
            b = np.insert(b, at, "x") if rng.random() < 0.4 else np.delete(b, at)
        m = (0, 1, 62, 63, 64, 65, 126, 127, 128)[k % 9]
        x, y = "".join(a), "".join(b)
        pairs.append(tuple(np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (x, y)))
        most.append(m)
        want.append(linededup.distance(x, y, m) <= m)
    assert 10 < sum(want) < 110
    assert linededup.within(pairs, np.array(most)).tolist() == want
    assert len(given) == 1 and given[0] <= 3 * len(pairs)


def test_words_of_equal_lines_have_equal_numbers():
    one, other = linededup.numbered(["the rain  stays", "rain the"])
    assert one.names[:2] == other.names[1::-1] and one.names[-1] == other.names[-1] == 0
    assert one.before == [0, 3, 7, 7, 12] and other.before == [0, 4, 7]
