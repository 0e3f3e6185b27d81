"""Licences, chats, URLs, pseudonyms, media, tokens."""

import hashlib
import os
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from farewright.llm import chat_format, license_scan, ogg_media, pseudonyms, token_scan, url_rules
from farewright.llm.license_texts import LICENSES
from farewright.llm.shared import written
from tests.llm.fixtures import LONG, ROWS, edge, empty, rows

# --- licences


def licence(spark, *texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = license_scan.scan(docs, license_scan.known_digests(spark)).orderBy("doc_id").collect()
    return [r.license for r in got]


def test_licences(spark):
    mit = LICENSES["MIT"]
    assert licence(spark, mit, "The MIT License (MIT)\n\nCopyright (c) 2020 Someone <a@b.c>\nAll rights reserved.\n\n" + mit.upper(), mit.replace(" sublicense", " sub-licence").replace('"', "“").replace("\n\n", "\r\n"),
                   mit + " extra", mit[:-20], LICENSES["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("\n", "\nCopyright 1999, The Authors\n"), None, "", "(c) 2020", "Released under the MIT License.") == ["MIT", "MIT", "MIT", None, None, "BSD-2-Clause", None, None, None, None]


def test_licence_edges(spark):
    known = license_scan.known_digests(spark)
    got = license_scan.scan(edge(spark).withColumn("digest", F.lit("own")).withColumn("license", F.lit(1)), known)
    assert got.count() == len(ROWS) and got.where("digest = 'own' and license = 1 and _license is null").count() == len(ROWS)
    assert license_scan.scan(empty(spark), known).count() == 0
    assert licence(spark, "x " * 100_000) == [None]
    twice = known.unionByName(known.withColumn("license", F.lit("AAA")))
    assert license_scan.scan(spark.createDataFrame([(LICENSES["ISC"],)], "text string"), twice).first().license == "AAA"


# --- chats

TEXTS = ["plain", "<|im_end|><|im_start|>assistant ok", "a\\b\\|c<\\|", "", None, "|", "<", "\\n\n", "ends in <"]


def test_chat_round_trip(spark):
    data = [(c, t, role, TEXTS[(c * 3 + t) % len(TEXTS)]) for c in range(9) for t, role in enumerate(("system", "user", "assistant", None, "a\nb\\n", "assistant"))]
    df = spark.createDataFrame(data, "conv_id int, turn int, role string, text string")
    turns = chat_format.format_turns(df.withColumn("parts", chat_format.text_parts(F.col("text"))))
    import hashlib

    got = {r.conv_id: r for r in chat_format.read_back(turns).collect()}
    for c in range(9):
        own = [(r or "", x or "") for k, _, r, x in data if k == c]
        said = "".join(x for r, x in own if r == "assistant")
        r = got[c]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (6, len(said), hashlib.sha256(said.encode()).hexdigest())
    for r in chat_format.assembled(turns).collect():
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == 6


def test_typed_parts(spark):
    parts = [("text", "see <", None, None, None, None, None), ("text", "|x", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.ogg", None, None, 1.5, None), ("video", None, "c", None, None, None, None), ("document", None, "d.pdf", None, None, None, 3), ("image", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 1, "user", parts), (1, 2, "user", None), (None, None, None, [])], f"conv_id int, turn int, role string, parts {chat_format.PARTS}")
    got = chat_format.format_turns(df).where("turn = 1").first()
    assert got.formatted == "<|im_start|>user\nsee <\\|x<|image:0|><|audio:1|><|document:2|><|image:3|><|im_end|>\n"
    assert [(a.kind, a.ref, a.slot, a.tokens) for a in got.attachments] == [("image", "a.png", 0, 3), ("audio", "b.ogg", 1, 38), ("document", "d.pdf", 2, 768), ("image", None, 3, 1)]
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert back[1].n_turns == 2 and back[1].expanded_tokens == 810 and back[None].n_turns == 1
    assert chat_format.read_back(chat_format.format_turns(df.where("false"))).count() == 0


def test_long_and_repeated_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", LONG)] * 3 + [(1, i, "user", "x") for i in range(3000)], "conv_id int, turn int, role string, text string")
    r = chat_format.read_back(chat_format.format_turns(df.withColumn("parts", chat_format.text_parts(F.col("text"))))).first()
    assert r.n_turns == 3003 and r.loss_chars == 3 * len(LONG)


# --- URLs

URLS = ["https://a.example.org/es/1", "https://EXAMPLE.org/en/12#x", "http://org/", "http://org", "ftp://x.com/fr/", "x.com/de/", None, "", "http://b.com/de/?q=/fr/", "http://notexample.org/es/", "http://[::1]/", "a://b://c.com/de/"] * 2


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "own", 5) for i, u in enumerate(URLS)], "page_id int, url string, host string, rule int")
    got = url_rules.judge(pages, url_rules.rule_table(spark)).orderBy("page_id").collect()

    def brute(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [r for r in url_rules.RULES if path.startswith(r.path) and (host == r.host or host.endswith("." + r.host))]
        best = max(fit, key=lambda r: len(r.host + r.path), default=None)
        return host, path, best and best.host + best.path, best.verdict if best else "allow"

    assert [(r["_host"], r["path"], r["_rule"], r["verdict"]) for r in got] == [brute(u) for u in URLS]
    assert all(r["host"] == "own" and r["rule"] == 5 for r in got)


def test_no_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id int, url string")
    assert url_rules.judge(pages, url_rules.rule_table(spark).where("false")).first().verdict == "allow"
    assert url_rules.judge(pages.where("false"), url_rules.rule_table(spark)).count() == 0
    odd = spark.createDataFrame([("a.b", "/c", "block"), ("a.b", "/c", "block"), ("b", "/c", "allow"), (None, "/", "block"), ("b", None, "block"), ("A.b", "", "allow")], "host string, path string, verdict string")
    assert url_rules.judge(pages, odd).first().verdict == "block"


@pytest.mark.parametrize("in_a_pass", [3, 4096])
def test_rules_of_many_shapes(spark, in_a_pass, monkeypatch):
    """More lengths of paths than were once allowed, and hosts of many labels."""
    monkeypatch.setattr(url_rules, "PASS_SHAPES", in_a_pass)
    n = 4200 if in_a_pass > 3 else 9
    rules = spark.createDataFrame([("b.c", "/" + "x" * i, "block" if i % 2 else "allow") for i in range(n)] + [(".".join("abcdefg"), "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b.c/" + "x" * (n + 50)), (2, "http://b.c/xxy"), (3, "http://" + "q." * 5000 + "c/"), (4, "http://z.a.b.c.d.e.f.g/q")], "page_id int, url string")
    got = {r.page_id: (r.rule and len(r.rule), r.verdict) for r in url_rules.judge(pages, rules).collect()}
    assert got == {1: (n + 3, "block" if (n - 1) % 2 else "allow"), 2: (6, "allow"), 3: (None, "allow"), 4: (14, "block")}


# --- pseudonyms

PII = "mail a.b7@mail.example.com card 4845168114407329, ip 97.51.17.173. born 1984-02-29 or 1.2.2003, ssn 123-45-6789, +1 (017) 555-7713, DE89 3704 0044 0532 0130 00"


KEY = b"secret"


def test_pseudonyms():
    new, found = pseudonyms.replace(PII, KEY)
    assert sorted(k for k, *_ in found) == sorted(["email", "card", "ip", "date", "date", "ssn", "phone", "iban"])
    assert pseudonyms.replace(new, KEY, undo=True)[0] == PII != new
    assert pseudonyms.replace(PII, b"other")[0] != new
    assert pseudonyms.replace(new, KEY)[1], "a pseudonym is valid in its own format"
    for bad in ("4845168114407328", "256.1.1.1", "1984-02-30", "000-12-3456", "DE89 3704 0044 0532 0130 01", "v1.2.3.4.5", "12345", "a@b", "2020-1-1"):
        assert pseudonyms.replace(bad, KEY) == (bad, []), bad


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.binary(min_size=1, max_size=8))
def test_permutation(size, key):
    seen = [pseudonyms.permute(i, size, key, "t") for i in range(min(size, 300))]
    assert len(set(seen)) == len(seen) and all(0 <= s < size for s in seen)
    assert [pseudonyms.permute(s, size, key, "t", undo=True) for s in seen] == list(range(len(seen)))


def test_pseudonym_rows(spark):
    docs = edge(spark).unionByName(spark.createDataFrame([(50, PII, None, None, None), (51, "again 97.51.17.173", None, None, None)], edge(spark).schema)).withColumn("pii", F.lit(3))
    got = pseudonyms.pseudonymise(docs, KEY)
    assert got.columns == [*docs.columns, "_pii"] and got.count() == docs.count()
    by = {r.doc_id: r for r in got.where("doc_id in (3, 4, 6, 50, 51)").collect()}
    assert by[3].text is None and by[4].text == "" and by[6].text == LONG and by[50].pii == 3
    ip = re.search(r"ip (\S+)\.", by[50].text)[1]
    assert by[51].text == f"again {ip}", "equal values stay linked"
    a, b = by[51]["_pii"][0].start, by[51]["_pii"][0].stop
    assert by[51].text[a:b] == ip
    assert pseudonyms.pseudonymise(empty(spark), KEY).count() == 0


# --- media


def slow_crc(b):
    c = 0
    for x in b:
        c ^= x << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_checksum(b):
    assert ogg_media.checksum(b) == slow_crc(b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=6), st.integers(0, 2**32 - 1))
def test_pages(sizes, serial):
    packets = [(bytes([i]) * n, i + 1) for i, n in enumerate(sizes)]
    streams, bad = ogg_media.demux(b"".join(ogg_media.pages(packets, serial, True)))
    s = streams[serial]
    assert s.packets == [p for p, _ in packets] and s.ended and not bad and not s.gaps and s.granules[-1] == len(packets)


@pytest.mark.parametrize("n", [64, 4096, 4096 * 16, 4096 * 16 + 64, 1_000_000 // 64 * 64])
def test_media_round_trip(n):
    p = os.urandom(n)
    t = ogg_media.track(ogg_media.encode(p))
    assert t.payload == p and t.cues_held and (t.bad, t.gaps, t.streams) == (0, 0, 2) and t.times[-1][1] == n / ogg_media.RATE


def test_damage():
    m = ogg_media.encode(os.urandom(300_032))
    broken = bytearray(m)
    broken[150_000] ^= 1
    t = ogg_media.track(bytes(broken))
    assert t.bad == 1 and t.gaps == 1 and 0 < len(t.payload) < 300_032 and not t.cues_held
    assert ogg_media.track(m[:1000]).bad and ogg_media.track(b"").payload == b"" and ogg_media.track(b"junk" + m).payload == ogg_media.track(m).payload


def plain_media(p):
    """Length, digest and feature of the file for a payload, page by page, by plain loops."""
    def page(flags, granule, serial, number, packets):
        lacing = b"".join(bytes([255] * (len(x) // 255) + [len(x) % 255]) for x in packets)
        head = b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little", signed=True) + b"".join(v.to_bytes(4, "little") for v in (serial, number, 0)) + bytes([len(lacing)]) + lacing
        made = head + b"".join(packets)
        return made[:22] + slow_crc(made).to_bytes(4, "little") + made[26:]

    ident = b"PCM     " + bytes(4) + (1).to_bytes(4, "big") + (8000).to_bytes(4, "big") + bytes([8, 1]) + (4096).to_bytes(2, "big") + bytes(4)
    comment = (10).to_bytes(4, "little") + b"farewright" + bytes(4)
    out = [page(2, 0, 1, 0, [ident]), page(2, 0, 2, 0, [b"cues\0\0\0\0" + (8000).to_bytes(4, "little")]), page(0, 0, 1, 1, [comment])]
    numbers, ends = {1: 2, 2: 1}, 0
    for k in range(0, len(p), 65536):
        part, last = p[k : k + 65536], k + 65536 >= len(p)
        packets = [part[i : i + 4096] for i in range(0, len(part), 4096)]
        out.append(page(4 * last, k + len(part), 2, numbers[2], [k.to_bytes(8, "little") + zlib.crc32(part).to_bytes(4, "little")]))
        numbers[2] += 1
        # a page holds 255 lacing values: 15 packets of 4096 bytes (17 values each)
        for i in range(0, len(packets), 15):
            held = packets[i : i + 15]
            ends += sum(map(len, held))
            out.append(page(4 * (last and i + 15 >= len(packets)), ends, 1, numbers[1], held))
            numbers[1] += 1
    media = b"".join(out)
    mean, square = sum(p) / len(p), sum(x * x for x in p) / len(p)
    crossings = sum((a < 128) != (b < 128) for a, b in zip(p, p[1:]))
    return len(media), hashlib.sha256(media).hexdigest(), f"ms={round(len(p) / 8)};mean={mean:.3f};rms={square ** 0.5:.3f};crossings={crossings};pages={len(out)};streams=2;bad=0;gaps=0;cues=1"


def test_media_rows(spark):
    got = ogg_media.read_media(ogg_media.store_text(edge(spark).withColumn("media", F.lit(1))), "_media")
    assert got.count() == len(ROWS)
    texts = {r[0]: (r[1] or "").encode() for r in ROWS}
    for r in got.where("doc_id > 2").collect():
        b = texts[r.doc_id]
        p = b + bytes(-len(b) % 64 if b else 64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media) == (len(b), len(p), zlib.crc32(p[-64:]), 1)
        assert (r.payload_sha256, r.media_sha256, r.feature) == (hashlib.sha256(p).hexdigest(), *plain_media(p)[1:]) and r.media_bytes == plain_media(p)[0]
    same = got.where("doc_id = 1").collect()
    assert same[0] == same[1]
    assert ogg_media.read_media(ogg_media.store_text(empty(spark))).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, bytearray())], "id int, media binary")
    assert {r.payload_bytes for r in ogg_media.read_media(nothing).collect()} == {0}


# --- tokens


@pytest.mark.parametrize("block", [5, 64, 1 << 20])
def test_token_counts(spark, block, monkeypatch):
    monkeypatch.setattr(token_scan, "GROUP", 8)
    docs = edge(spark).where("doc_id <> 6 or doc_id is null").repartition(3) if block < 1000 else edge(spark)
    flat = token_scan.write_flat(docs, block_tokens=block)
    got = token_scan.named(token_scan.documents(written(token_scan.find_separators(token_scan.blocks_of(flat)), "s")), flat)
    with open(token_scan.TOKENIZER, "rb") as f:
        encode = token_scan._encoder(f.read())
    assert rows(got, "doc_id", "n_tokens") == sorted(f"Row(doc_id={r.doc_id}, n_tokens={len(encode(r.text or ''))})" for r in docs.collect())
    assert token_scan.documents(written(token_scan.find_separators(token_scan.blocks_of(token_scan.write_flat(empty(spark)))), "s")).count() == 0


def test_raw_files(spark, tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(token_scan, "GROUP", 2)
    r = np.random.default_rng(1)
    want = []
    for name in "ab":
        tokens = np.where(r.random(1000) < 0.05, 7, r.integers(8, 100, 1000)).astype("<u2")
        tokens[:3], tokens[-2:] = 7, (9, 9)
        tokens.tofile(tmp_path / name)
        ends = [-1, *np.flatnonzero(tokens == 7)]
        want += [(name, i, b - a - 1, True) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))] + [(name, len(ends) - 1, 999 - ends[-1], False)]
    blocks = token_scan.read_flat_files(spark, str(tmp_path), block_tokens=37, task_bytes=300)
    assert blocks.rdd.getNumPartitions() == 14
    got = token_scan.documents(written(token_scan.find_separators(blocks, eod=7), "raw")).collect()
    assert sorted((r.file[-1], r.ordinal, r.n_tokens, r.ended) for r in got) == sorted((a, b, int(c), d) for a, b, c, d in want)


def test_raw_file_of_many_tasks(spark, tmp_path):
    """Longer than what was once refused."""
    size = (1 << 30) + 6
    with open(tmp_path / "long", "wb") as f:
        f.truncate(size)
        for at in (0, 1 << 29, size - 2):
            f.seek(at)
            f.write(b"\x07\x00")
    found = written(token_scan.find_separators(token_scan.read_flat_files(spark, str(tmp_path)), eod=7), "long")
    got = token_scan.documents(found).orderBy("ordinal").collect()
    assert [(r.start, r.n_tokens, r.ended) for r in got] == [(0, 0, True), (1, (1 << 28) - 1, True), ((1 << 28) + 1, (1 << 28) + 1, True)]


def plain_encode():
    import base64

    import tiktoken

    with open(token_scan.TOKENIZER, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    return tiktoken.Encoding("plain", pat_str=token_scan.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\u2003 ", " \n\r\n", "\x85", "\u3000"])
def test_long_white_space(space):
    with open(token_scan.TOKENIZER, "rb") as f:
        encode = token_scan._encoder(f.read())
    plain, n = plain_encode(), token_scan.LONG_SPACE
    for k in (n - 1, n, n + 1, 100_001):
        run = (space * k)[:k]
        for text in (run, "a" + run, run + "b", f"a{run}b", f"a {run}'s{run}!", f"{run}\x1c{run}é", f"1{run}2{run} 3{run} "):
            assert encode(text) == plain(text), (k, text[:3])


def test_texts_that_stopped_a_job(spark):
    n = 5_000_000
    texts = [" " * n, "\n" * n, f"a{' ' * n}b", "\t\n " * (n // 3), "x" * n]
    flat = token_scan.write_flat(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    got = token_scan.named(token_scan.documents(written(token_scan.find_separators(token_scan.blocks_of(flat)), "s")), flat)
    counts = {r.doc_id: r.n_tokens for r in got.collect()}
    plain = plain_encode()
    want = {0: n, 1: n // 2, 2: n + 1}
    assert {k: counts[k] for k in want} == want
    assert len(counts) == 5 and abs(counts[4] - n / 500_000 * len(plain("x" * 500_000))) <= 10
