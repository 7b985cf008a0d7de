import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join
from tessera.llm.components import components
from tests.llm.brute import classes


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_classes(df).collect()}


def near_copies(rng, n, size, most, start=0):
    base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append((start + i * 3, " ".join(w)))
    return out


def test_against_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert result(docs) == classes([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_large_group_of_near_copies_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(5)
    docs = near_copies(rng, 150, 90, 4) + near_copies(rng, 60, 40, 2, 1) + near_copies(rng, 40, 200, 9, 2)
    docs += [(9000 + i, docs[0][1]) for i in range(30)] + [(9500 + i, " ".join(docs[0][1].split()[: 5 + i])) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(df) == classes(docs)


def test_a_passage_that_many_share_links_nothing(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(f"u{rng.randrange(10**7)}" for _ in range(40)) + " " + passage) for i in range(200)]
    docs += [(500 + i, passage + " " + " ".join(f"v{rng.randrange(10**7)}" for _ in range(i))) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(df) == classes(docs)


def test_a_large_group_of_which_none_can_link_makes_no_blocks(spark):
    # A passage of 80 shingles that 100,000 share, each with words of its own: no two reach 0.8, and none is paired.
    every = spark.range(1, 100_001).selectExpr("0L as hub", "id as node", "100L + id % 5 as n", "80L as c", "id as label", "0L as main")
    assert ngram_join.cross_blocks(every).count() == 0
    # Where a pair may link, no pair of classes that may is missing.
    rng = random.Random(8)
    rows = [(0, i, n, n - rng.randrange(n // 4), i, 0) for i in range(1, 300) for n in [rng.randrange(20, 200)]]
    classed, pairs = ngram_join.class_pairs(spark.createDataFrame(rows, "hub long, node long, n long, c long, label long, main long"))
    kind = {r["node"]: (r["kind"], r["n"], r["c"]) for r in classed.collect()}
    have = {(r["kind1"], r["kind2"]) for r in pairs.collect()}
    want = {(a[0], b[0]) for a in kind.values() for b in kind.values() if 9 * min(a[2], b[2]) >= 4 * (a[1] + b[1]) and 5 * min(a[1], b[1]) >= 4 * max(a[1], b[1])}
    assert want <= have and len(have) < len({k for k, _, _ in kind.values()}) ** 2 / 2


def test_own_words_beside_a_passage(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(80)]
    docs = [(i, " ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([0, 3, 9, 12, 16, 20]))])) for i in range(150)]
    assert result(spark.createDataFrame(docs, "doc_id long, text string")) == classes(docs)


def test_disk_holds_a_slice_of_the_postings_and_about_a_set_for_each_node(spark, monkeypatch):
    rng = random.Random(12)
    passage, alive, blocks = [f"p{i}" for i in range(80)], {}, []
    docs = [(i, " ".join(f"u{rng.randrange(10**7)}" for _ in range(200))) for i in range(300)]
    docs += [(1000 + i, " ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([9, 12, 16, 20]))])) for i in range(150)]
    stage, drop, join = ngram_join.stage, ngram_join.drop_staged, ngram_join.join_blocks

    def staged(df, name, *args, **more):
        assert name != "prefixes" or "survey" not in alive.values()
        out = stage(df, name, *args, **more)
        alive[out.staged_path] = name
        return out

    def joined(rows, keys):
        blocks.append(rows.count())
        return join(rows, keys)

    monkeypatch.setattr(ngram_join, "stage", staged)
    monkeypatch.setattr(ngram_join, "drop_staged", lambda df: (alive.pop(df.staged_path, None), drop(df)))
    monkeypatch.setattr(ngram_join, "join_blocks", joined)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    last = max((x.stageId() for x in stages()), default=-1)
    assert result(spark.createDataFrame(docs, "doc_id long, text string")) == classes(docs)
    written = [x.shuffleWriteRecords() for x in stages() if x.stageId() > last]
    postings = sum(ngram_join.prefix_size(len(ngram_join.shingles(t))) for _, t in docs)
    assert postings > 10_000 and postings / 8 < max(written) < postings / 2
    assert len(blocks) > 2 and max(blocks) < 2 * 150


def test_small_groups_share_blocks(spark):
    rows = spark.range(1200).selectExpr("id div 2 as hub", "id as node")
    sizes = [r["count"] for r in ngram_join.bundled(rows, F.lit(True), F.xxhash64("hub")).groupBy("block").count().collect()]
    assert sum(sizes) == 1200 and min(sizes) > ngram_join.FANOUT and max(sizes) < 3 * ngram_join.BLOCK


def words(name, n):
    return [f"{name}q{i}" for i in range(n)]


def lost_link(salt):
    """Texts of a group of 12 whose hub also has a partner by rare shingles only, and in which a (nearest to x, outside the group) and b
    link only with each other. Rows repeated 30 times make their shingles common, so that they stay out of the prefixes."""
    w = words(f"{salt}w", 44)
    r, e = [words(f"{salt}r{i}", 8) for i in range(10)], [words(f"{salt}e{i}", 4) for i in range(10)]
    group = [w + r[i] + e[i] for i in range(10)]
    node = lambda t: ngram_join.node_of(ngram_join.shingles(" ".join(t)))
    h = min(range(10), key=lambda i: node(group[i]))
    own, v, f = words(f"{salt}o", 10), words(f"{salt}v", 40), words(f"{salt}f", 40)
    a, b, x, c = w + own, w, w[40:] + own + v, w[40:] + r[h] + f
    common = [(r[i] + e[i])[4:] for i in range(10)] + [own[6:] + v + words(f"{salt}y", 20), r[h][4:] + f + words(f"{salt}z", 20)]
    fits = node(group[h]) < min(node(a), node(b), node(c)) and node(x) < node(a)
    return [" ".join(t) for t in [a, b, *group, x, c] + 30 * common] if fits else None


def test_partners_of_a_hub_do_not_pass_for_members_of_its_group(spark):
    docs = list(enumerate(next(t for k in range(99) if (t := lost_link(f"k{k}")))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = result(df)
    assert got[1] == (40, 0) and got == classes(docs)


def test_threshold_is_inclusive(spark):
    # 18 shingles shared of 22 and 23 together: 0.8 is met at 20 of 25
    def doc(n, tail):
        return " ".join([f"c{i}" for i in range(n)] + tail)

    docs = [(0, doc(24, [])), (1, doc(24, [f"t{i}" for i in range(5)])), (2, doc(24, [f"s{i}" for i in range(6)])), (3, "A b C d E"), (4, "a B c D e"), (5, "a b"), (6, "A  B")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = result(df)
    assert got == classes(docs) and got[1] == (25, 0) and got[2] == (26, 2) and got[6] == (1, 5)


def test_odd_rows(odd, empty):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in ngram_join.join_classes(odd).collect())
    assert len(got) == odd.count() and (0, 0, 0) in got and (2, 0, 2) in got and (11, 1, 10) in got and (-1, 2, None) in got
    assert (4, 1, 4) in got and got.count((7, 1, 7)) == 2
    assert ngram_join.join_classes(empty).count() == 0
    assert ngram_join.join_classes(odd.where("doc_id is null or text is null")).count() == 2


def test_keep_one(odd, empty):
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect())
    assert ids == [-1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert ngram_join.keep_one(empty).count() == 0


def test_keep_one_of_ids_with_several_texts(spark):
    one, two, three = (" ".join(words(x, 30)) for x in "abc")
    rows = [(1, one), (2, one), (2, two), (2, two.upper()), (3, two), (3, three), (3, three), (4, None), (4, one), (5, "e"), (6, "e"), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"] or 0, (r["text"] or "").lower()) for r in ngram_join.keep_one(docs).collect()))
    assert kept == [(0, one), (1, one), (2, two), (3, three), (4, ""), (5, "e")]


def test_tree_prunes_but_loses_no_link():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = []
    for _ in range(40):
        core = rng.choice(pool, 100, replace=False)
        sets += [np.unique(np.concatenate([core[: 100 - k], rng.choice(pool, k)])) for k in (0, 3, 8, 20)]
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    tree = ngram_join.SignatureTree(sets, 256)
    assert len(tree.levels) > 2
    kept = {(min(i, j), max(i, j)) for i, j in tree.pairs(tree).tolist() if i != j}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if ngram_join.linked(sets[i], sets[j])}
    assert want <= kept and len(kept) < len(sets) * (len(sets) - 1) // 4


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(2)
    links = {"path": [(i, i + 1) for i in range(60)] + [(100, 101)], "star": [(5, i) for i in range(10, 300)] + [(i, i) for i in range(3)], "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]}[kind]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
