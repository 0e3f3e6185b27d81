"""Near duplicates, decontamination, mixing, language identification, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from farewright.llm import decontaminate, language_id, mixing, pseudonyms, simhash_dedup
from farewright.llm.components import components
from farewright.llm.queries import QUERIES
from farewright.llm.shared import written
from tests.llm.fixtures import LONG, ROWS, SCHEMA, edge, empty, rows, text
from tests.oracle import SF

# --- near duplicates


def plain_print(t, shingle=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, near):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def near_docs(n=40):
    r, out = random.Random(5), []
    for i in range(n):
        w = text(i, 400).split()
        out.append(" ".join(w))
        for _ in range(r.randrange(4)):
            w = list(w)
            w[r.randrange(400)] = f"edit{r.random()}"
            out.append(" ".join(w))
    return out


def test_simhash_is_brute_force(spark):
    data = [(r[0], r[1]) for r in ROWS] + [(100 + i, t) for i, t in enumerate(near_docs())]
    random.Random(1).shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit("own"))
    got = simhash_dedup.near_duplicates(docs).collect()
    prints = [plain_print(t) for _, t in data]
    g = groups(len(data), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = defaultdict(lambda: None)
    for k, (d, _) in zip(g, data, strict=True):
        least[k] = d if least[k] is None else least[k] if d is None else min(least[k], d)
    want = Counter((d, p if p < 1 << 63 else p - (1 << 64), least[k]) for (d, _), p, k in zip(data, prints, g, strict=True))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in got) == want
    assert max(Counter(g).values()) >= 3
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_all_links_of_random_prints(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base:
        for k in range(1, 6):
            x = b
            for bit in r.sample(range(64), k):
                x ^= 1 << bit
            prints.add(x)
    signed = sorted(p if p < 1 << 63 else p - (1 << 64) for p in prints)
    df = spark.createDataFrame([(t, p) for p in signed for t in (0, 1)], "t int, fp long")
    want = {(t, a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3 for t in (0, 1)}
    got = [(x.t, x.a, x.b) for x in simhash_dedup.links(df).collect()]
    assert set(got) == want and len(got) == len(want) > 200


def test_tables_are_brute_force(spark):
    """A link in any table counts; documents with one fingerprint are linked whatever the others are."""
    data = [(r[0], r[1]) for r in ROWS] + [(100 + i, t) for i, t in enumerate(near_docs(30))]
    got = simhash_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), tables=3).collect()
    prints = [[p & (2**64 - 1) for p in simhash_dedup.fingerprints((t or "").encode(), 3, 3)] for _, t in data]
    g = groups(len(data), lambda i, j: any((a ^ b).bit_count() <= 3 for a, b in zip(prints[i], prints[j], strict=True)))
    least = defaultdict(lambda: None)
    for k, (d, _) in zip(g, data, strict=True):
        least[k] = d if least[k] is None else least[k] if d is None else min(least[k], d)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((d, least[k]) for (d, _), k in zip(data, g, strict=True))


def test_large_group_of_near_copies(spark):
    """100,000 near copies of one text: no more links than rows, and one component."""
    words = text(1, 800).split()

    def copies(ids):
        for frame in ids:
            frame["text"] = [" ".join([*words[: i % 797], f"edit{i}", *words[i % 797 + 1 :]]) for i in frame["id"]]
            yield frame

    docs = spark.range(100_000, numPartitions=16).mapInPandas(copies, "id long, text string").withColumnRenamed("id", "doc_id")
    rows_ = written(simhash_dedup.with_fingerprints(docs, "text", "fps"), "near")
    prints = rows_.select(F.lit(0).alias("t"), F.col("fps")[0].alias("fp")).distinct()
    n_prints, n_links = prints.count(), simhash_dedup.links(prints).count()
    assert 1 < n_prints < 5_000 and n_links < 100_000
    tied = components(simhash_dedup.links(prints).select("a", "b")).agg(F.count("*"), F.count_distinct("root")).first()
    assert tied[0] > 0.9 * n_prints and tied[1] < 0.05 * n_prints + 2


def test_representatives(spark):
    docs = edge(spark).withColumn("d", F.lit(1)).withColumn("th", F.lit("x"))
    got = simhash_dedup.representatives(docs, shingle=5, tables=4)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter([1, 2, 3, None, 6, 7, 8, 9])
    assert simhash_dedup.representatives(empty(spark)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)}


# --- decontamination


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain_hits(t, items, slop=0, size=10):
    w, hit, found = plain_words(t), set(), set()
    for item, s in items:
        x = plain_words(s)
        for k in range(max(1, len(x) - size + 1)) if x else ():
            win = x[k : k + size]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item) if item is not None else "")
    return len(w), len(hit), sorted(found)


ITEMS = [(1, text(7, 25)), (2, text(8, 10)), (10, "Short One"), (3, None), (4, " ,. "), (None, "single"), (1, text(9, 12)), (5, text(7, 25)), (6, "same same same same same same same same same same same")]


def planted(spark):
    a, b = text(7, 25).split(), text(8, 10)
    extra = [(200, "x " + " ".join(a[3:20]) + " y"), (201, b.upper().replace(" ", "--")), (202, "a short, one! b"), (203, " ".join(a[:9])), (204, "single"), (205, f"{b} {b}"), (206, "same " * 30), (207, " ".join(a + a))]
    return edge(spark).unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in extra], SCHEMA))


@pytest.mark.parametrize("max_terms", [1_000_000, 20])
def test_contamination_is_brute_force(spark, max_terms, monkeypatch):
    monkeypatch.setattr(decontaminate, "build_index", lambda *a, f=decontaminate.build_index, **k: f(*a, **k, max_terms=max_terms))
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ROWS", 3 if max_terms == 20 else 1000)
    docs = planted(spark).withColumn("term", F.lit(0)).withColumn("d", F.lit(1))
    got = decontaminate.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    want = [(r.doc_id, *plain_hits(r.text, ITEMS)) for r in planted(spark).collect()]
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect()) == Counter((d, n, h, ",".join(i)) for d, n, h, i in want)
    assert sum(h > 0 for *_, h, _ in want) >= 7


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(empty(spark), items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(edge(spark), items.where("false")).collect()} == {0}


def test_proximity(spark):
    w = text(8, 10).split()
    swapped = [*w[:4], w[5], w[4], *w[6:]]
    gapped = [*w[:5], "gap", *w[5:]]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(swapped)), (3, " ".join(gapped)), (4, " ".join(reversed(w)))], "doc_id long, text string")
    items = spark.createDataFrame([(2, text(8, 10))], "item_id long, text string")
    hits = lambda s: {r.doc_id for r in decontaminate.contamination(docs, items, slop=s).where("n_hit > 0").collect()}
    assert hits(0) == {1} and hits(1) == {1, 2, 3}


# --- mixing


def test_targets(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), (None, 50), ("", 0)]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    names, w = ["", "a", "b", "c", None], [3, 1, 2, 3, 1]
    size = {s: n for s, n in sizes}
    left, open_, want = 1.5 * 1160, set(range(5)), {}
    while True:
        rate = left / sum(w[i] for i in open_)
        over = {i for i in open_ if rate * w[i] > 2 * size[names[i]]}
        if not over:
            break
        for i in over:
            want[i] = 2 * size[names[i]]
            left -= want[i]
        open_ -= over
    want |= {i: rate * w[i] for i in open_}
    for i, s in enumerate(names):
        assert got[s].target == pytest.approx(want[i])


def test_tree_deals_every_block(spark):
    q = spark.createDataFrame([(1, 5), (2, 300), (3, 0), (4, 41)], "sid long, n long")
    for depth, fan in ((0, 2), (3, 256), (9, 256), (3, 2)):
        got = mixing.split_quotas(q, depth, fan).collect()
        assert {s: sum(r.n for r in got if r.sid == s) for s in (1, 2, 3, 4)} == {1: 5, 2: 300, 3: 0, 4: 41}
        each = Counter(dict.fromkeys(range(2**depth), 0))
        for r in got:
            assert r.n >= 0
            each[r.shard] += r.n
        assert len(each) == 2**depth and max(each.values()) - min(each.values()) <= 1


def test_groups_of_sources_have_the_same_distribution(spark):
    """Blocks of source 1 in the first of two shards, over many seeds, with all sources in one row and
    in groups of two: 6 of 20 blocks drawn 10 at a time."""
    from math import comb

    q = spark.createDataFrame([(1, 6), (2, 5), (3, 4), (4, 5)], "sid long, n long")
    trees = lambda wants: [mixing._deal(q.withColumn("g", F.floor(F.col("sid") / 2 if wants else F.lit(-1)).cast("long")), 1, wants)]
    assert {(r.shard, r.n) for t in trees(None) for r in t.groupBy("shard").agg(F.sum("n").alias("n")).collect()} == {(0, 10), (1, 10)}
    wants = mixing.split_quotas(q.groupBy(F.floor(F.col("sid") / 2).alias("sid")).agg(F.sum("n").alias("n")), 1)
    got = trees(wants)[0].withColumn("sid", F.floor(F.col("sid") / 2)).groupBy("shard", "sid").agg(F.sum("n").alias("n")).collect()
    assert {(r.shard, r.sid): r.n for r in got} == {(r.shard, r.sid): r.n for r in wants.collect() if r.n}
    # many independent halvings at once: each group g is a tree of its own, with its own random numbers
    many = spark.range(3000).select((F.col("id") * 4).alias("b")).select(F.expr("b div 4").alias("g"), F.explode(F.expr("transform(array(6L, 5L, 4L, 5L), (n, i) -> named_struct('sid', b + i, 'n', n))")).alias("x")).select("g", "x.*")
    left = mixing._deal(many, 1, None).where("shard = 0 and sid % 4 = 0")
    seen = Counter({r.n: r.k for r in left.groupBy("n").agg(F.count("*").alias("k")).collect()})
    seen[0] = 3000 - sum(seen.values())
    for k in range(7):
        assert abs(seen[k] / 3000 - comb(6, k) * comb(14, 10 - k) / comb(20, 10)) < 0.03


def test_many_sources_and_no_ids(spark):
    """100,000 sources, and one of a third of all rows whose ids are all null."""
    docs = spark.range(150_000).select(
        F.when(F.col("id") < 100_000, F.col("id")).alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id"), F.repeat(F.lit("x "), (F.col("id") % 7).cast("int"))).alias("text"),
        F.when(F.col("id") < 100_000, F.concat(F.lit("host"), F.col("id").cast("string"))).otherwise("hot").alias("source"))
    rows_ = written(mixing.sized(docs), "many")
    made = mixing.plan(rows_, block_words=2000, shard_words=50_000)
    out = written(mixing.mix(rows_, made), "mixed")
    by = out.groupBy("source").agg(F.sum(F.col("size") * F.size("copies")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"))
    assert out.count() == 150_000 and by.where("abs(taken - target) > most").count() == 0
    hot = mixing.placed(rows_, made.sources).where("source = 'hot'").groupBy("block").agg(F.sum("size").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert hot[0] < 3 * 2000 and hot[1] > 100
    shards = out.select(F.explode("copies").alias("c"), "size").groupBy("c.shard").agg(F.sum("size").alias("n")).agg(F.max("n"), F.avg("n")).first()
    assert shards[0] < 3 * shards[1]


def test_hypergeometric(spark):
    """Inverse of the distribution: probabilities against exact binomials."""
    from math import comb

    for total, marked, drawn in ((20, 7, 9), (1, 1, 1), (50, 49, 25), (6, 0, 3), (400, 200, 200)):
        call = mixing._hypergeometric("t", "k", "m", "u")
        n = 4000
        df = spark.range(n).selectExpr(f"{total}L AS t", f"{marked}L AS k", f"{drawn}L AS m", f"(id + 0.5D) / {n} AS u").selectExpr(f"{call} AS x")
        got = Counter(r.x for r in df.collect())
        for x in range(max(0, drawn - total + marked), min(marked, drawn) + 1):
            assert abs(got[x] / n - comb(marked, x) * comb(total - marked, drawn - x) / comb(total, drawn)) < 2 / n + 1e-9


def test_mix(spark):
    docs = spark.createDataFrame([(i, text(i, 1 + i % 60), "en", f"s{min(i % 7, 3)}", 1) for i in range(600)], SCHEMA).unionByName(edge(spark))
    made = lambda: mixing.mix(written(mixing.sized(docs), "z"), mixing.plan(written(mixing.sized(docs), "z"), block_words=300, shard_words=1000))
    one = made().collect()
    assert sorted(map(repr, one)) == sorted(map(repr, made().collect())), "reruns agree"
    assert len(one) == docs.count()
    by = defaultdict(list)
    for r in one:
        assert len(r.copies) <= 2 and len({c["pass"] for c in r.copies}) == len(r.copies)
        by[r.source].append(r)
    for own in by.values():
        taken = sum(r.size * len(r.copies) for r in own)
        assert abs(taken - own[0].target) <= max(r.size for r in own) and own[0].source_size == sum(r.size for r in own)
    shards = Counter(c.shard for r in one for c in r.copies)
    assert len(shards) > 8


def test_mixed_rows(spark):
    docs = edge(spark).withColumn("mix_shard", F.lit("own")).withColumn("size", F.lit(1))
    got = mixing.mixed_documents(docs)
    assert got.columns == [*docs.columns, "_mix_shard", "mix_pass", "mix_place"]
    assert max(Counter(r.doc_id for r in got.collect()).values()) <= 4
    assert mixing.mixed_documents(empty(spark)).count() == 0
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- language


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op10_language_id"](spark, SF).join(docs, "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.95 and 0 <= r[1] <= r[2] <= 1


def sentences(seed, n, words):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


EN, DE = "the and of that thing with another through".split(), "und der nicht eine über schön werden zwischen".split()


@pytest.fixture(scope="module")
def model(spark):
    rows = [(sentences(i, 50, EN), "en") for i in range(20)] + [(sentences(i, 50, DE), "de") for i in range(20)] + [(None, "en"), ("x", None), ("", "fr")]
    return language_id.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_mixtures(model):
    assert model.languages == ["de", "en", "fr"]
    mixed = sentences(1, 150, EN) + " " + sentences(2, 50, DE)
    chosen, share = language_id.mixture(model, mixed)
    assert [model.languages[i] for i in chosen] == ["en", "de"] and share[0] == pytest.approx(0.72, abs=0.1) and share.sum() == pytest.approx(1)
    assert [model.languages[i] for i in language_id.mixture(model, sentences(3, 60, DE))[0]] == ["de"]
    assert language_id.mixture(model, "123 !! ²") [0] == [] and language_id.mixture(model, None)[0] == []


def plain_mixture(model, t, penalty=1.0):
    """The mixture by plain loops, trying languages whether or not they could gain."""
    from math import log

    p = model.rows(np.arange(language_id.BUCKETS)).of(list(range(len(model.languages))))
    # words are joined by one space, so each pair of neighbours has trigrams across it
    joined = f" {' '.join(re.findall(r'[^\W\d_]+', t.lower()))} ".encode()
    seen = Counter()
    for x, y, z in zip(joined, joined[1:], joined[2:]):
        h = ((x * 0x9E3779B1) & 0xFFFFFFFF) ^ ((y * 0x85EBCA77) & 0xFFFFFFFF) ^ ((z * 0xC2B2AE3D) & 0xFFFFFFFF)
        seen[(h ^ h >> 15) & 0xFFFF] += 1
    n = sum(seen.values())

    def em(chosen):
        share = {k: 1 / len(chosen) for k in chosen}
        for _ in range(language_id.ROUNDS if len(chosen) > 1 else 0):
            new = dict.fromkeys(chosen, 0.0)
            for b, c in seen.items():
                whole = sum(share[k] * p[k, b] for k in chosen)
                for k in chosen:
                    new[k] += c * share[k] * p[k, b] / whole
            share = {k: v / n for k, v in new.items()}
        return share, sum(c * log(sum(share[k] * p[k, b] for k in chosen)) for b, c in seen.items())

    everyone = range(len(model.languages))
    best = [max(everyone, key=lambda k: em([k])[1])]
    share, reached = em(best)
    order = em(list(everyone))[0]
    for k in sorted(everyone, key=lambda k: -order[k]):
        if k != best[0]:
            tried, likelihood = em([*best, k])
            if likelihood - reached <= penalty * log(n + 1) or tried[k] < 0.01:
                break
            best, share, reached = [*best, k], tried, likelihood
    return {k: share[k] for k in best}


def test_mixture_is_plain_em(spark, model):
    r, sizes = random.Random(6), Counter()
    for i in range(150):
        t = " ".join(sentences(i * 7 + j, r.choice((0, 0, 3, 12, 40)), w) for j, w in enumerate((EN, DE, ["zwxq", "qqj"]))) + " the"
        want = plain_mixture(model, t)
        chosen, share = language_id.mixture(model, t)
        assert set(chosen) == set(want) and all(want[k] == pytest.approx(x, abs=1e-6) for k, x in zip(chosen, share, strict=True)), t
        sizes[len(chosen)] += 1
    assert min(sizes[1], sizes[2]) > 20


def test_chunks_and_unknown_scripts(spark, model, monkeypatch):
    t = sentences(5, 400, EN + DE)
    whole = language_id.trigrams(t)
    monkeypatch.setattr(language_id, "CHUNK", 50)
    cut = language_id.trigrams(t)
    # each cut takes the two trigrams across a blank from one place and adds none within a word
    assert set(cut[0]) <= set(whole[0]) and 0 <= whole[1].sum() - cut[1].sum() <= 2 * len(t) // 50 and (cut[1].sum() - whole[1].sum()) <= 0
    monkeypatch.undo()
    docs = spark.createDataFrame([(1, sentences(1, 60, EN)), (2, "это текст на другом языке " * 5), (3, "一二三四五六七八九十"), (4, sentences(2, 60, DE))], "doc_id int, text string")
    assert {r.doc_id for r in language_id.identify(docs, model).where("lang_fit > 0.5").collect()} == {1, 4}


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(language_id, "HELD", 2)
    rows_ = [(sentences(i, 5, EN), f"l{i % 9}") for i in range(90)]
    few = language_id.fit(spark.createDataFrame(rows_, "text string, lang string").coalesce(1))
    monkeypatch.undo()
    whole = language_id.fit(spark.createDataFrame(rows_, "text string, lang string"))
    every = np.arange(language_id.BUCKETS)
    assert (few.rows(every).of(list(range(9))) == whole.rows(every).of(list(range(9)))).all() and len(few.languages) == 9
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 8)
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame(rows_, "text string, lang string"))
    monkeypatch.undo()
    monkeypatch.setattr(language_id, "MAX_ENTRIES", 8)
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame(rows_, "text string, lang string"))


def test_hundreds_of_languages(spark):
    """300 languages of their own words; a text in one of them, and one in two, are told from all others."""
    r = random.Random(8)
    words = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(300)}
    model = language_id.fit(spark.createDataFrame([(sentences(i, 60, w), name) for name, w in words.items() for i in range(2)], "text string, lang string"))
    assert model.languages == sorted(words)
    docs = spark.createDataFrame([(k, sentences(k, 40, w) + " " + sentences(k, 40 * (k % 2), words["l007"])) for k, w in enumerate(words.values())], "doc_id int, text string")
    for row in language_id.identify(docs, model).collect():
        assert {x.lang for x in row.langs} == {f"l{row.doc_id:03d}", *(["l007"] * (row.doc_id % 2))}


def test_language_rows(spark, model):
    got = language_id.identify(edge(spark).withColumn("score", F.lit(7)), model)
    assert got.count() == len(ROWS) and "_score" in got.columns
    by = defaultdict(set)
    for r in got.collect():
        by[r.doc_id].add((r.lang_pred, r["_score"], r.score))
    assert by[3] == by[4] == by[5] == by[8] == {("und", 0.0, 7)} and len(by[1]) == 1 and {x[0] for x in by[6]} <= {"en", "de", "fr"}
    assert language_id.identify(empty(spark), model).count() == 0
    none = language_id.fit(empty(spark))
    assert none.languages == [] and language_id.identify(edge(spark), none).select("lang_pred").distinct().first()[0] == "und"


# --- pipeline


def test_stages_are_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(90001, None, "en", "src1", 0), (90002, "1 2 3", "en", "src1", 5), (90003, LONG, "en", None, 1)], SCHEMA))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "pii", "mixing"]
    kept = written(stages["language"](spark, docs, SF), "t1")
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {90001, 90002}

    data = sorted(kept.collect(), key=lambda r: r.doc_id)
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r.text.translate({c: c + 32 for c in range(65, 91)}).encode().split() for r in data)]
    g = groups(len(data), lambda i, j: 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]))
    one = written(stages["near_duplicates"](spark, kept, SF), "t2")
    assert sorted(r.doc_id for r in one.collect()) == sorted(data[i].doc_id for i in set(g)) and one.columns == docs.columns

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [plain_words(t)] for i in range(max(1, len(w) - 9))}
    assert min(map(len, windows)) == 10
    dirty = {r.doc_id for r in one.collect() for w in [plain_words(r.text)] if any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))}
    clean = written(stages["decontamination"](spark, one, SF), "t3")
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - dirty and dirty

    hidden = written(stages["pii"](spark, clean, SF), "t4")
    assert rows(hidden, "doc_id", "text") == sorted(map(repr, spark.createDataFrame([(r.doc_id, pseudonyms.replace(r.text, corpus_pipeline.DEMONSTRATION_KEY.encode())[0]) for r in clean.collect()], "doc_id long, text string").collect()))

    mixed = stages["mixing"](spark, hidden, SF)
    rows_ = written(mixing.sized(hidden), "t5")
    want = Counter({r.doc_id: len(r.copies) for r in mixing.mix(rows_, mixing.plan(rows_)).collect()})
    assert Counter(r.doc_id for r in mixed.collect()) == want and max(want.values()) == 2


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = edge(spark).withColumn("score", F.lit(1)).withColumn("pii", F.lit("x"))
    out = stage(spark, docs, SF)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() > 0
    assert stage(spark, empty(spark), SF).count() == 0
