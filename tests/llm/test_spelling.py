"""Spelling variants against all pairs, in whole subtries and in subtries that are split."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from farewright.llm import spelling
from farewright.llm.shared import written
from tests.llm.fixtures import LONG, edge, empty


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def all_pairs(words):
    return sorted(tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p))


@pytest.mark.parametrize("letters, step", [("ab", 1), ("ab", -1), ("abcé", 1), ("abcé", -1), ("a", 1)])
def test_forest(letters, step):
    r = random.Random(letters)
    for _ in range(40):
        words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(8))) for _ in range(60)})
        root = np.array([r.randrange(3) for _ in words])
        n = np.array([len(w) for w in words])
        at = np.cumsum(n) - n
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        i, j = spelling.near_in_forest(root, codes, at if step > 0 else at + n - 1, np.full(len(words), step), n)
        want = sorted(p for k in range(3) for p in all_pairs([w for w, x in zip(words, root) if x == k]))
        assert sorted(tuple(sorted((words[a], words[b]))) for a, b in zip(i, j)) == want


def dense():
    """Words with all kinds of edits at all places, and many behind one prefix, around one middle and before one end."""
    r, words = random.Random(5), set()
    for _ in range(40):
        w = "".join(r.choice("abé") for _ in range(r.randrange(7, 14)))
        for _ in range(6):
            words.add(w)
            k, c = r.randrange(len(w) + 1), r.choice("abc")
            w = r.choice([w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :]])
    for a, b in itertools.product("abcdef", repeat=2):
        words |= {"aaaaaa" + a + b, a + b + "aaaaaa", "aaaa" + a + "aaaa" + b * 2, "x" * 300 + a + "y" * 200 + b}
    return sorted(w for w in words if len(w) >= 7)


@pytest.mark.parametrize("group", [1, 6, 40, 10_000])
def test_pairs(spark, group):
    words = dense()
    vocab = written(spark.createDataFrame([(w, len(w)) for w in words], "word string, n long"), "words")
    got = spelling.near_pairs(vocab, group=group).collect()
    assert sorted(tuple(sorted((x.a, x.b))) for x in got) == all_pairs(words)
    assert all(x.na == len(x.a) and x.nb == len(x.b) for x in got)


def test_short_words(spark):
    words = ["a", "b", "ab", "ba", "abc", "é", "xy"]
    vocab = written(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), "words")
    assert sorted(tuple(sorted((x.a, x.b))) for x in spelling.near_pairs(vocab, min_length=1).collect()) == all_pairs(words)


def test_forms(spark):
    """Ties of forms go to the first in code-point order; roots are where chains end."""
    n = {"balloon": 10_000, "baloon": 9_999, "ballon": 99, "ballonn": 10, "bbllonn": 1, "ballonz": 9, "marketé": 50, "marketa": 5, "marketb": 50, "wordless": 3}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), min_length=6).collect()}
    for w in n:
        near = [v for v in n if one_edit(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= 10 * n[w] else None
        assert (got[w].form, got[w].n_near, got[w].form_n) == (form, len(near), n[form] if form else None)
        root = w
        while got[root].form:
            root = got[root].form
        assert got[w].root == root
    assert got["bbllonn"].form == "ballonn" and got["bbllonn"].root == "balloon" and got["marketa"].form == "marketb" and got["wordless"].root == "wordless"


def test_vocabulary(spark):
    """A-Z alone is folded, × and ÷ are letters of the class, nulls and empty texts have no words, repeats count."""
    rows = [(1, "Abcdefg ABCDEFG abcdefgÉ1abcdefgÉ"), (1, "Abcdefg ABCDEFG abcdefgÉ1abcdefgÉ"), (2, None), (3, ""), (None, "abc×÷def short"), (4, "abc×÷def onlyonce")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == {"abcdefg": 4, "abcdefgÉ": 4, "abc×÷def": 2}
    assert spelling.variants(spelling.vocabulary(empty(spark))).collect() == []
    want = Counter(w for r in edge(spark).collect() if r.text for w in spelling.re.findall(f"{spelling.RUN}+", r.text) if len(w) >= 7)
    assert {r.word: r.n for r in spelling.vocabulary(edge(spark)).collect()} == {w: n for w, n in want.items() if n >= 2} and LONG


def test_slips(spark):
    import zlib

    docs = [(i, "elephant giraffe_ rhinoceros") for i in range(200)]
    want = Counter()
    for i, t in docs:
        for w in ("elephant", "giraffe", "rhinoceros"):
            h = zlib.crc32(f"{i}:{w}".encode())
            k = h % len(w)
            want[w[:k] + w[k + 1 :] if h % 5 == 0 else w] += 1
    got = spelling.vocabulary(spark.createDataFrame(docs, "doc_id long, text string"), slip=5)
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
