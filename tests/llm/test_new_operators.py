"""Packing, fill-in-middle and the filter audit against brute force; exact ids and long texts in every operator."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import audit, chat, decontaminate, fim, flac, license_scan, mixing, packing, quality, simhash, token_count, url_filter, warc

BIG = 2**53
TEXTS = ["naïve ünïcode ✓ ok", None, "", "a <P> b", "\n\n\nx\r\ny\u2028z", "word " * 3000, "same", "same", "\U0001f600\nb\n", "no end"]
IDS = [BIG + 1, None, BIG + 3, 4, 5, BIG + 7, 6, 6, 0, -3]


@pytest.fixture
def odd(spark):
    rows = [(i, t, f"s{n % 2}" if n else None, None if n % 3 == 0 else "en", "clash") for n, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]
    names = "n", "form", "output", "h1", "ids", "start", "open", "part", "good", "sha", "first"
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, length string")
    return df.withColumns({c: F.lit("mine") for c in names}).coalesce(1)


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) else "spm" if h[3] % 100 < 50 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, n, form, *((None, None) if form == "plain" else (len(p), len(m))), sha(out), sha(text)


def test_fim(spark, sf, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (sf, str(tmp_path)):
        got = sorted(map(tuple, fim.op12_fim(spark, folder).collect()), key=repr)
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        assert got == sorted((plain_fim(*r) for r in docs), key=repr)
    assert fim.transform(odd.limit(0)).count() == 0
    forms = Counter(r.form for r in fim.transform(odd, rate=0).collect())
    assert forms == {"plain": len(TEXTS)}


def test_fim_units():
    cp = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4")
    for t in (" a  bc d ", "x", "", "  ", "a\n\nb"):
        for unit, pattern in (("line", r"[^\n]*\n|[^\n]+"), ("word", r"\A\s+|\S+\s*"), ("char", r"(?s).")):
            assert fim.boundaries(cp(t), unit).tolist() == list(itertools.accumulate(map(len, re.findall(pattern, t))))
    with pytest.raises(ValueError, match="unit"):
        fim.boundaries(cp("x"), "page")


def plain_audit(docs, labels):
    first, marks = {}, defaultdict(lambda: [False, False])
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        marks[i][0] |= q == 1
        marks[i][1] |= x == 1
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > first[t],
        }
        rows.append((lang or "", fails, *(marks[i] if i is not None else (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                shapley[f] += len(gone)
                left = [r for r in left if not r[1][f]]
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(r[1][f] for r in own) - len(gone), sum(sum(r[1].values()) == 1 and r[1][f] for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f,
                ]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return out


def test_audit(spark, sf, odd):
    labels = spark.createDataFrame([(BIG + 1, 1, 0), (BIG + 1, 0, 1), (None, 1, 1), (6, 1, None), (4, None, 1)], "doc_id long, quality int, toxic int")
    many = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 9)).unionByName(odd.withColumns({"text": F.lit("Loud #WORDS"), "lang": F.lit("")}))
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    for d, m in ((many, labels), (read("documents"), read("labels"))):
        got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.report(audit.verdicts(d, m)).collect()}
        want = plain_audit(d.select("doc_id", "text", "lang").collect(), m.select("doc_id", "quality", "toxic").collect())
        assert got == want and len(got) == 600 * len({k[0] for k in want})
    assert audit.report(audit.verdicts(odd.limit(0), labels)).count() == 0


def test_audit_visits_each_state_once(spark, monkeypatch):
    rows = spark.createDataFrame([("x", i & 1 > 0, i & 2 > 0, i & 4 > 0, False, False) for i in range(8)], "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    e = audit.edges(rows, "ABC").collect()
    assert len(e) == 12 and {(r.state, r.filter) for r in e} == {(s, f) for s in range(7) for i, f in enumerate("ABC") if not s >> i & 1}
    assert {(r.state, r.filter): r.removed for r in e}[3, "C"] == 1 and not any(spark.sparkContext._jsc.getPersistentRDDs())


@pytest.fixture
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def own_tokens(path, texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def check_packing(pieces, docs, path, length=1024):
    """Every identifier lies in one piece, sequences are gapless; the share of padding is returned."""
    left, ids = Counter(), own_tokens(path, [t for _, t in docs])
    for (i, _), x in zip(docs, ids, strict=True):
        left[i, tuple(x) + (0,)] += 1
    own, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for (i, x), times in left.items():
        for p in own[i]:
            if p.doc_tokens == len(x) and times == 1 and sum(d == i for d, _ in docs) == 1:
                assert zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        if sum(d == i for d, _ in docs) == 1:
            spans = sorted((p.start, p.length) for p in own[i])
            assert [s for s, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1] and sum(n for _, n in spans) == len(x)
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in ids)
    padding = 0
    for spans in sequences.values():
        spans.sort()
        size = sum(n for _, n in spans)
        assert [s for s, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1] and 0 < size <= length
        padding += 0 if size & (size - 1) == 0 else length - size
    return padding / max(1, sum(p.length for p in pieces))


def test_packing(spark, sf, odd, vocabulary):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_packing(packing.op11_packing(spark, sf).collect(), known, vocabulary) < 0.01
    digest = lambda df: df.withColumn("ids_crc32", F.crc32("ids")).collect()
    for parts, windows, slack, fan_in in ((1, 1, 0, 2), (7, 3, 0, 2), (40, 8, 5, 3)):
        got = digest(packing.pack(docs.repartition(parts), vocabulary, 256, windows, slack, fan_in=fan_in))
        assert check_packing(got, known, vocabulary, 256) < slack / 128 + 1e-9
    got = digest(packing.pack(odd, vocabulary))
    assert check_packing(got, list(zip(IDS, TEXTS, strict=True)), vocabulary) == 0
    assert {r.doc_id for r in got} == set(IDS) and sum(r.doc_id == 6 and r.start == 0 for r in got) == 2
    assert packing.pack(odd.limit(0), vocabulary).count() == 0


def test_bounded_space():
    p = packing.Packer(16, 3)
    out = [w for n in (9, 12, 10, 5, 7, 3, 40) for w in p.put(n, 0, n, np.arange(n, dtype=np.uint32))]
    size = lambda w: sum(len(x[3]) for x in w)
    assert [[x[0] for x in w] for w in out] == [[9, 7], [40], [40]] and [size(w) for w in p.rest()] == [15, 15, 8]
    assert [size(w) for w in packing.merged(p.rest(), 16)] == [16, 16, 4, 2]
    p = packing.Packer(16, 1, slack=4)
    assert [[size(w) for w in p.put(n, 0, n, np.arange(n))] for n in (12, 9, 10)] == [[], [12], [16]] and [size(w) for w in p.rest()] == [3]


def test_tokens_of_long_runs(vocabulary, monkeypatch):
    texts = ["a" + " " * 9 + "b", " " * 30, "\n" * 12 + "x", "x\r\n\u3000\u2003 \t y", "\x1c" * 9, "'s 'S  don't", "ab cd " * 9, "<|endoftext|>", "漢字 かな" * 5]
    monkeypatch.setattr(token_count, "_RUN", re.compile(f"[{token_count.BLANKS}]{{3,}}"))
    monkeypatch.setattr(token_count, "STRETCH", 7)
    assert [token_count.tokens(t, vocabulary).tolist() for t in texts] == own_tokens(vocabulary, texts)
    monkeypatch.undo()
    for t, n in ((" " * 10_000_000, 10_000_000), ("\n" * 10_000_000 + "x", 5_000_002), ("x" + " " * 1_000_000, 1_000_001)):
        assert len(token_count.tokens(t, vocabulary)) == n


def test_counts_stand_at_their_documents(spark, odd, vocabulary):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    want = Counter(zip(IDS, map(len, own_tokens(vocabulary, TEXTS)), strict=True))
    for block in (2, 64, 4 << 20):
        assert Counter(map(tuple, token_count.count_tokens(odd, path, block_bytes=block).collect())) == want


def test_big_ids_beside_nulls(spark, sf, odd, vocabulary):
    """No operator loses a row or changes an id above 2^53 that shares its partition with a null."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "word " * 12), (2, "naïve ünïcode ✓ ok")], "item_id long, text string")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    want = Counter(IDS)
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("http://h.com/en/").alias("url"), F.col("text").alias("html")).coalesce(1)
    folder = warc.fresh_path(spark, "warc-ids")
    per_row = {
        "op3": warc.read(spark, folder, warc.write(pages, folder)).select("page_id"), "op4": url_filter.judge(pages, url_filter.rule_table(spark)).select("page_id"),
        "op5": quality.classify(odd.select("doc_id", "text"), labels).select("doc_id"), "op6": license_scan.scan(odd).select("doc_id"), "op7": mixing.mix(odd).select("doc_id"),
        "op8": simhash.near_duplicates(odd).select("doc_id"), "op9": flac.features(flac.store(odd)).select("doc_id"), "op10": token_count.count_tokens(odd, path).select("doc_id"),
        "op12": fim.transform(odd).select("doc_id"),
    }
    for name, df in per_row.items():
        assert Counter(r[0] for r in df.collect()) == want, name
    blocks = flac.pcm_blocks(flac.store(odd)).select("doc_id").distinct()
    assert {r[0] for r in blocks.collect()} == set(IDS)
    assert {r.doc_id for r in decontaminate.contaminated(odd, bench).collect()} == {BIG + 1, BIG + 7}
    turns = spark.createDataFrame([(i, BIG + n, "user", "x") for n, i in enumerate(IDS)], "conv_id long, turn long, role string, text string").coalesce(1)
    assert {r.conv_id for r in chat.repair(turns).collect()} == set(IDS)
    assert {r.doc_id for r in mixing.mixed(odd).collect()} >= {BIG + 1, BIG + 7, None} - {None}
    kept = {r.doc_id for r in simhash.keep_one(odd, similar=True).collect()}
    assert kept == {BIG + 1, BIG + 3, 4, 5, BIG + 7, 6, 0, -3}
    assert {r.doc_id for r in decontaminate.clean(odd, bench).collect()} == set(IDS) - {BIG + 1, BIG + 7}


def test_hosts_of_many_labels(spark):
    many = ".".join(["a"] * 100_000)
    urls = [f"x://{many}.example.com/en/7", f"x://{many}/en/", f"x://{many}.net/de/8", "x://net/de/", "x://.net/de/1", "x://a./x"]
    rules = spark.createDataFrame([("", "/", "block")], "host string, path string, verdict string").unionByName(url_filter.rule_table(spark))
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("example.com/en/7", "allow"), (None, "allow"), ("net/de/", "block"), ("net/de/", "block"), ("net/de/", "block"), (None, "allow")]


def test_exploded_fingerprints_are_never_broadcast(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(simhash, "components", lambda links: asked.append(links) or spark.createDataFrame([], "node long, label long"))
    simhash.link_components(spark.range(1000).selectExpr("xxhash64(id) AS fp")).count()
    plan = asked[-1]._jdf.queryExecution().sparkPlan().toString()  # as Spark's own thresholds have it
    assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin [key" not in plan.split("SortMergeJoin")[0]


def test_rules_of_the_url_filter_are_the_contracts(spark):
    urls = ["x://a.com/en/1", "x://example.com/en/7", "x://a.net/de/1", "x://example.net/de/8", "x://a.org/es/1"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rule_table(spark)).orderBy("page_id").collect()
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    assert [(r.rule, r.verdict) for r in got] == want
