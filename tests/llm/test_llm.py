"""The training-data operators: brute force, round trips, and odd inputs."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import chat, decontaminate, flac, license_scan, mixing, quality, registry, simhash, token_count, url_filter, warc

ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "word " * 3000), (None, "null id here with some words"), (6, "same text twice over here"), (6, "same text twice over here"), (7, "naïve ünïcode ✓ ok yes")]


@pytest.fixture
def odd(spark):
    rows = [(i, t, f"s{n % 2}" if n else None, n, "clash", 1.0, "k") for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, label string, score double, text_key string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 8)] + [(None, None)], "doc_id long, quality int")


def test_oracles(spark, sf):
    agree(spark, sf, registry.ORACLE)


def test_oracles_where_nothing_is_broadcast(spark, sf, monkeypatch):
    for module in (decontaminate, license_scan, url_filter):
        monkeypatch.setattr(module, "bounded", lambda df, *_: df)
    agree(spark, sf, [n for n in registry.ORACLE if n.startswith(("op1_", "op4_", "op6_"))])


def agree(spark, sf, names):
    import os

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    for name in names:
        got, want = registry.QUERIES[name](spark, sf), con.sql(registry.ORACLE[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        rows = lambda c, d: sorted(tuple(show(r[c.index(x)]) for x in cols) for r in d)
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()), name


def plain_fingerprint(text):
    """SimHash written without the operator."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(len(w) - 4, 0) + 1)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def test_hashes_of_many_strings_at_once():
    import pyarrow as pa

    from marlstone.llm import shingles

    rng = random.Random(1)
    strings = [rng.randbytes(rng.randint(0, 90)) for _ in range(3000)] + [rng.randbytes(400)] * 20
    size = np.array([len(b) for b in strings])
    data, at = np.frombuffer(b"".join(strings) + bytes(8), np.uint8).copy(), np.cumsum(size) - size
    for seed in (0, 42):
        assert shingles.xxh64(data, at, size, seed).tolist() == [xxhash.xxh64_intdigest(b, seed) for b in strings]
    texts = [t for _, t in ODD] + ["A b\tC", "x  y z w v ", "é" * 9, "w " * 70_000]
    column = pa.array(["left out", *texts])[1:]
    got = [int(x) for a, b in shingles.slices(column, 20_000) for x in shingles.fingerprints(shingles.words(column.slice(a, b - a)), 4, 42)]
    assert got == [plain_fingerprint(t) for t in texts]
    for t, keys in zip(texts, shingles.shingle_keys(shingles.words(column), 5), strict=True):
        w = (t or "").encode().lower().split()
        assert len(keys) == (len({tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)}) if w else 0)


def test_simhash_components(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    all_ = docs.collect()
    fp = {r.doc_id: plain_fingerprint(r.text) for r in all_}
    own = {d: d for d in fp}
    for _ in range(len(fp)):
        new = {a: min(own[b] for b in fp if (fp[a] ^ fp[b]).bit_count() <= 4) for a in fp}
        if new == own:
            break
        own = new
    assert got == {d: (f"{fp[d]:016x}", own[d]) for d in fp}


def test_simhash_finds_all_distances(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for d in range(1, 7):
            fps.add(b ^ sum(1 << k for k in random.sample(range(64), d)))
    dense = random.getrandbits(64)
    fps |= {dense ^ x for x in range(512)} | {dense ^ 0b1111 << 50 ^ x for x in range(3)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.fp % (1 << 64): r.label for r in simhash.link_components(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    group = {f: i for i, f in enumerate(fps)}
    for _ in range(60):
        new = {a: min(group[b] for b in fps if (a ^ b).bit_count() <= 4) for a in fps}
        if new == group:
            break
        group = new
    pairs = {}
    for f in fps:
        assert pairs.setdefault(group[f], got[f]) == got[f]
    assert len(set(pairs.values())) == len(pairs)


def test_simhash_odd(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def brute_similar(texts, width=5):
    """Pairs of texts with a Jaccard similarity of 0.8 or more of their word shingles, written without the operator."""
    sets = []
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets.append({b" ".join(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set())
    return [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def test_similar_copies_go_at_any_distance(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(words) for _ in range(12))
    texts = [None, "", "one two", "One  TWO", "one two three", line, line + " end"]
    for n in (5, 6, 12, 30, 60, 200, 400):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(base) + (" " + line if n > 100 else ""))
            for changes in (1, 2, 4, 8):
                copy = list(base)
                for at in rng.sample(range(n), min(changes, n)):
                    copy[at] = rng.choice(words)
                texts.append(" ".join(copy))
    big = [rng.choice(words) for _ in range(80)]
    texts += [" ".join(big[: i % 9] + ["x"] * (i % 2) + big[i % 9 + i % 3 :]) + f" y{i}" for i in range(150)]
    pairs = brute_similar(texts)
    fps = [simhash.fingerprint(t) for t in texts]
    near = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert any((fps[i] ^ fps[j]).bit_count() > 4 for i, j in pairs)
    own = list(range(len(texts)))
    while True:
        new = list(own)
        for i, j in pairs + near:
            new[i] = new[j] = min(new[i], new[j])
        if new == own:
            break
        own = new
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for broadcast in (True, False):
        if not broadcast:
            monkeypatch.setattr(simhash, "bounded", lambda df, *_: df)
        got = sorted(r.doc_id for r in simhash.keep_one(docs, similar=True).collect())
        assert got == sorted(set(own))
    assert simhash.keep_one(docs.limit(0), similar=True).count() == 0


def test_dedup_stage_leaves_no_similar_pair(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.where("n_chars > 600").orderBy("doc_id").first()
    words = first.text.split(" ")
    words[len(words) // 2] = "changed"
    docs = docs.unionByName(spark.createDataFrame([(10**9, " ".join(words), first.lang, first.source, first.n_chars)], docs.schema))
    kept = [r.text for r in pipeline.dedup_stage(spark, docs, sf).collect()]
    assert brute_similar(kept) == [] and brute_similar([first.text, " ".join(words)]) == [(0, 1)]


def test_decontamination(spark, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    half = " ".join(item.split()[:8])
    docs = spark.createDataFrame([(1, "x " * 5000 + item.upper().replace(" ", ", ")), (2, half), (3, item.replace("mu", "nu")), (4, "tiny item"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, item), (12, "Tiny item!"), (13, ""), (14, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.containment, 3) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 10): 1.0, (1, 11): 1.0, (3, 10): 0.875, (3, 11): 0.875, (4, 12): 1.0}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [2, 5]
    assert decontaminate.clean(odd, items).columns == odd.columns and decontaminate.clean(odd, items).count() == len(ODD)
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.contaminated(odd.limit(0), items).count() == 0


def test_license_odd(spark, odd):
    got = license_scan.scan(odd).collect()
    assert len(got) == len(ODD) and all(r.labels == "" and r.n_base == 0 and r.first_word is None for r in got)
    docs = spark.createDataFrame([(1, "mit license, MIT-License " + "x " * 500 + "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    r = license_scan.scan(docs).first()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (3, 0, 506, "cc-by,mit", "cc-by,cc-by-nc-4.0,mit")
    assert license_scan.scan(odd.limit(0)).count() == 0


def test_license_each_in_a_block(spark):
    apache, mit, nc, by = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0."
    texts = [f"{apache} {mit}", f"{mit} {apache}", f"{by} See {nc}", f"{nc} See {by}", nc, f"{nc} {nc}", by, f"{apache} Released under MIT License."]
    want = [{"apache-2.0", "mit-notice"}] * 2 + [{"cc-by-4.0", "cc-by-nc-4.0"}] * 2 + [{"cc-by-nc-4.0"}] * 2 + [{"cc-by-4.0"}, {"apache-2.0", "mit-notice"}]
    rows = [(i * 100 + pad, "x " * pad + t) for i, t in enumerate(texts) for pad in (0, 3, 9, 15)]
    got = {r.doc_id: set(r.labels.split(",")) - {"apache", "mit", "cc-by"} for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want[i // 100] for i, _ in rows}


def test_mixing_odd(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, got))
    assert mixing.mix(odd.limit(0)).count() == 0
    clash = odd.withColumns({n: F.lit("mine") for n in ("_id", "_key", "_rows", "_row_key", "_row")})
    assert [r["_id"] for r in mixing.mixed(clash).collect()] == ["mine"] * mixing.mixed(odd).count()
    out = mixing.mixed(odd)
    assert out.columns == [*odd.columns, "size", "target", "taken", "copies"] and out.where("copies < 1").count() == 0


def test_quality(spark, sf, odd, labels):
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, marks).join(marks, "doc_id").where("held_out").toPandas()
    good, bad = (got[got.quality == q].score.to_numpy() for q in (1, 0))
    assert not len(bad) or (good[:, None] > bad[None]).mean() > 0.9
    out = quality.classify(odd.drop("score", "label"), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns
    assert quality.classify(odd.limit(0), labels).count() == 0


def test_risk_is_learnt_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    p = rng.normal(1, 1, (500, 5)).astype(np.float32)
    u = np.vstack([rng.normal(1, 1, (600, 5)), rng.normal(-1, 1, (400, 5))]).astype(np.float32)
    w = quality.non_negative_pu(p, u, 0.6)
    z = u @ w[:-1] + w[-1]
    assert ((z > 0) == (np.arange(1000) < 600)).mean() > 0.93


def cheapest(roles):
    """Least (cost, turns) of all repairs of some turns, by trying every one; written without the operator."""
    import re

    best = None
    each = [("", r, False) for r in "sua"] + [("", r, True) for r in "sua"] + [(put, r, False) for put in "sua" for r in "sua"]
    for plan in itertools.product(each, repeat=len(roles)):
        out, cost = "", 0
        for (put, to, joins), role in zip(plan, roles, strict=True):
            cost += 4 * len(put) + 3 * (role != to)
            if joins:
                if not out or out[-1] != to:
                    break
                cost += 2
            else:
                out += put + to
        else:
            for end in ("", "a", "ua"):
                if re.fullmatch("s?(ua)+", out + end):
                    best = min(best or (999, 0), (cost + 4 * len(end), len(out + end)))
    return best


def test_chat_is_cheapest(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "tool", None, " Human "]
    letter = {"user": "u", "assistant": "a", "system": "s", " Human ": "u"}
    given = {c: [rng.choice(roles) for _ in range(rng.randint(1, 4))] for c in range(40)}
    rows = [(c, i, r, f"t{i}") for c, rs in given.items() for i, r in enumerate(rs)]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    for c, g in got.groupby("conv_id"):
        a = g["action"].value_counts()
        paid = 2 * (a.get("merge", 0) + a.get("merge+relabel", 0)) + 3 * (a.get("relabel", 0) + a.get("merge+relabel", 0)) + 4 * a.get("insert", 0)
        assert (paid, g.out_turn.max() + 1) == cheapest([letter.get(r, "?") for r in given[c]])
        text = "".join(g.sort_values(["row_no", "piece"]).rendered)
        said = [x.split("|>")[0] for x in text.split("<|") if not x.startswith("end")][1:]
        assert said[-1] == "assistant" and text.endswith("<|end|>\n") and all(x != y for x, y in itertools.pairwise(said))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.repair(empty).count() == 0
    same = spark.createDataFrame([(None, None, "user", "x")] * 3, empty.schema)
    assert [(r.action, r.n_rows) for r in chat.repair(same).orderBy("row_no").collect()] == [("keep", 3), ("insert", 0)]


def test_chat_is_the_same_however_dealt(spark):
    rng = random.Random(7)
    rows = [(c, i, rng.choice(["user", "assistant", "system", "tool", None]), f"t{i}") for c, n in enumerate([900, 3, 1, 400, 2, 60]) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    got = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 4, 23):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(repr, chat.repair(df).collect())))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got[0] == got[1] == got[2]


def test_warc_round_trip(spark):
    rows = [(5, "http://a/b c", "<p>x</p>"), (2, "http://a", "<p>x</p>"), (3, None, None), (1, "", ""), (2, "http://a", "<p>x</p>"), (None, "u", "only"), (9, "u", "ü" * 70000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, sha string")
    from marlstone.llm.common import fresh_path

    folder = fresh_path(spark, "warc-test")
    manifest = warc.write(pages, folder, roll_bytes=200)
    got = warc.read(spark, folder, manifest).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted(
        [(1, "response", None, 0), (3, "revisit", 1, 0), (2, "response", None, 8), (2, "revisit", 2, 8), (5, "revisit", 2, 8), (0, "response", None, 4), (9, "response", None, 140000)], key=lambda x: (x[0], x[1], x[2] or 0)
    )
    assert {r.payload.decode() for r in got if r.page_id == 9} == {"ü" * 70000} and all(r.payload_digest == warc.digest(r.payload) for r in got if r.payload is not None)
    one, two = (sorted((r.file, r.sha1) for r in warc.write(pages, fresh_path(spark, "warc-test"), 200).collect()) for _ in range(2))
    assert one == two
    assert warc.write(pages.limit(0), fresh_path(spark, "warc-test")).count() == 0


def test_url_filter_with_a_full_filter(spark):
    many = spark.createDataFrame([(f"h{i}.example", "/", "block") for i in range(0, 3000, 2)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"x://h{i}.example/a") for i in range(3000)], "page_id long, url string")
    got = url_filter.judge(pages, many, most_blocks=2).where("verdict = 'block'").selectExpr("count(*)", "sum(page_id % 2)").first()
    assert got[:] == (1500, 0)


def test_warc_gives_the_same_bytes_however_dealt(spark):
    from marlstone.llm.common import fresh_path

    rng = random.Random(3)
    rows = [(i * 7919 % 4001, f"http://h/{i}", "<p>" + " ".join(rng.choice("abcdef") * 9 for _ in range(rng.randint(0, 60))) + "</p>") for i in range(3000)]
    pages = spark.createDataFrame([*rows, *[(2**60 + 1, "u", "<p>big id</p>"), (2**60 + 2, "u", "<p>big id</p>"), (None, "u", "x")]], "page_id long, url string, html string")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    got = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n, order in ((4, "page_id"), (4, "url"), (7, "html")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            manifest = warc.write(pages.orderBy(order), folder := fresh_path(spark, "warc-test"), roll_bytes=20_000, shard_bytes=400_000)
            got.append(sorted(map(tuple, manifest.collect())))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got[0] == got[1] == got[2] and len({x[1] for x in got[0]}) > 3 and max(x[2] for x in got[0]) > 0
    assert {r.refers_to for r in warc.read(spark, folder, manifest).where(f"page_id = {2**60 + 2}").collect()} == {2**60 + 1}


def test_url_filter_odd(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/75?x", "x://net/de/", "x://internet/de/1", "x://org", "a://b.com/en/#f://c", "x://b.com/en/"]
    got = url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), url_filter.rule_table(spark))
    want = [("", "", None, "allow")] * 3 + [("example.com", "/en/75", "example.com/en/7", "allow"), ("net", "/de/", "net/de/", "block"), ("internet", "/de/1", None, "allow"), ("org", "", None, "allow"), ("b.com", "/en/", "com/en/", "block"), ("b.com", "/en/", "com/en/", "block")]
    assert [tuple(r)[1:] for r in got.orderBy("page_id").collect()] == want
    many = spark.createDataFrame([(f"h{i}.example", "/", "block") for i in range(3000)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"x://h{i}.example/a") for i in range(6000)], "page_id long, url string")
    assert url_filter.judge(pages, many).where("verdict = 'block'").selectExpr("count(*)", "max(page_id)").first()[:] == (3000, 2999)
    assert url_filter.judge(pages.limit(0), many).count() == 0 and url_filter.judge(pages, many.limit(0)).count() == 6000


def test_flac_round_trip_and_damage():
    random.seed(2)
    for n in (1, 2, 191, 192, 4095, 4096, 4097, 9000):
        for data in (random.randbytes(n), b"a" * n, bytes(random.choice(b"the quick brown fox ") for _ in range(n))):
            for linear in (None, ((30, -12, 3), 7, 5)):
                media = flac.encode(data, linear=linear)
                got = list(flac.decode_frames(media))
                assert b"".join((x[0] + flac.SHIFT).astype(np.uint8).tobytes() for _, _, x in got) == data
                assert [o for _, o, _ in got] == list(range(0, n, flac.BLOCK))
    media = flac.encode(b"some text " * 2000)
    for at in (50, len(media) // 2, len(media) - 1):
        with pytest.raises(flac.FlacError):
            list(flac.decode_frames(media[:at] + bytes([media[at] ^ 4]) + media[at + 1 :]))


def plain_flac(media):
    """Samples of a mono 8-bit stream, decoded bit by bit; written without the operator."""
    assert media[:4] == b"fLaC" and media[4] == 0x80
    at, out, kinds = 8 + int.from_bytes(media[5:8], "big"), [], set()
    bits = "".join(f"{b:08b}" for b in media)
    while at < len(media):
        p = at + 4
        p += 1 if media[p] < 0x80 else 8 - (media[p] ^ 0xFF).bit_length() - 1  # the frame's number
        n = 4096
        if media[at + 2] >> 4 == 7:
            n, p = int.from_bytes(media[p : p + 2], "big") + 1, p + 2
        p = (p + 1) * 8  # its header's checksum

        def take(k, signed=False):
            nonlocal p
            v, p = int(bits[p : p + k], 2) if k else 0, p + k
            return v - (1 << k) if signed and v >> (k - 1) else v

        kind = take(8) >> 1
        kinds.add("constant" if kind == 0 else "plain" if kind == 1 else "fixed" if kind < 16 else "linear")
        if kind == 0:
            x = [take(8, True)] * n
        elif kind == 1:
            x = [take(8, True) for _ in range(n)]
        else:
            order = kind - 8 if kind < 16 else kind - 31
            x = [take(8, True) for _ in range(order)]
            shift, coef = 0, {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}.get(order)
            if kind >= 32:
                precision, shift = take(4) + 1, take(5)
                coef = [take(precision, True) for _ in range(order)]
            assert take(6) == 0
            k = take(4)
            while len(x) < n:
                q = bits.index("1", p) - p
                p += q + 1
                u = (q << k) | take(k)
                x.append((u >> 1 ^ -(u & 1)) + (sum(c * x[-1 - i] for i, c in enumerate(coef)) >> shift))
        out += x
        at = (p + 7) // 8 + 2
    return out, kinds


def test_flac_columns(odd):
    """Every column of op9 against plain Python and a decoder of its own."""
    import hashlib
    import zlib

    media = flac.store(odd)
    stored = sorted((r.doc_id or 0, r.n_bytes, bytes(r.media)) for r in media.collect())
    got = sorted(flac.features(media).collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    assert len(got) == len(stored) == len(ODD)
    for r, (doc, n, data), (_, text) in zip(got, stored, sorted(((i or 0, t) for i, t in ODD), key=lambda x: (x[0], len((x[1] or "").encode()))), strict=True):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        x, _ = plain_flac(data)
        assert bytes((v + 108) & 255 for v in x) == payload
        mean = sum(x) // len(x)
        crossings = sum((a - mean < 0) != (b - mean < 0) for a, b in itertools.pairwise(x))
        said = f"peak={max(map(abs, x))};energy={sum(v * v for v in x) // len(x)};crossings={crossings};low={min(x)};high={max(x)}"
        assert tuple(r) == (doc or None, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), said) and n == len(raw)
    blocks = flac.pcm_blocks(media).where("doc_id = 5").orderBy("sample_offset").collect()
    assert [b.sample_offset for b in blocks] == list(range(0, 15168, 4096))
    assert b"".join(bytes((b + flac.SHIFT) & 255 for b in r.pcm) for r in blocks).rstrip() == ("word " * 3000).encode().rstrip()
    assert flac.features(flac.store(odd.limit(0))).count() == 0


def test_flac_takes_the_shortest_predictor():
    rng = random.Random(4)
    wave = bytes(int(108 + 60 * np.sin(i / 5) + rng.randint(-1, 1)) & 255 for i in range(9000))
    noise, prose = rng.randbytes(5000), " ".join(rng.choice(["the", "quick", "brown", "fox", "jumps"]) for _ in range(4000)).encode()
    seen = set()
    for data in (wave, noise, prose, b"a" * 4096, bytes(range(100, 130)) * 300):
        media = flac.encode(data)
        x, kinds = plain_flac(media)
        assert bytes((v + flac.SHIFT) & 255 for v in x) == data
        assert b"".join((p[0] + flac.SHIFT).astype(np.uint8).tobytes() for _, _, p in flac.decode_frames(media)) == data
        seen |= kinds
    assert seen >= {"constant", "plain", "linear"}


def test_token_counts(spark, odd):
    import os

    path = os.path.join(token_count.TOKENIZERS, token_count.VOCABULARY)
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    want = sorted(len(token_count.tokens(t, path)) for _, t in ODD)
    for block in (2, 64, 4 << 20):
        assert sorted(r.n_tokens for r in token_count.count_tokens(odd, path, block_bytes=block).collect()) == want
    assert token_count.count_tokens(odd.limit(0), path).count() == 0


def test_stages_odd(spark, sf, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ("_text_key", "_quality_score", "_id", "_key", "_rows", "_row", "_row_key", "id", "grp", "key", "h", "bad", "n", "fp", "held_out", "predicted")
    docs = odd.withColumns({n: F.lit("mine") for n in names})
    want = {"quality classifier": None, "simhash near-dedup": [0, 1, 4, 5, 6, 7], "benchmark decontamination": sorted((i or 0) for i, _ in ODD), "mixing to target weights": None}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns and all(r[n] == "mine" for r in rows for n in names)
        if want[name]:
            assert sorted(r.doc_id or 0 for r in rows) == want[name]
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_repeats_with_other_columns_are_settled(spark):
    rows = [(1, "one two three four five", f"v{i}") for i in range(20)]
    kept = [simhash.keep_one(spark.createDataFrame(rows[i:] + rows[:i], "doc_id long, text string, other string")).first().other for i in (0, 7, 13)]
    assert len(set(kept)) == 1


def test_prior_of_known_mixtures():
    rng = np.random.default_rng(2)
    for prior in (0.3, 0.6, 0.85):
        p = rng.normal(1.5, 1, (3000, 6)).astype(np.float32)
        n = int(3000 * prior)
        u = np.vstack([rng.normal(1.5, 1, (n, 6)), rng.normal(-1.5, 1, (3000 - n, 6))]).astype(np.float32)
        rng.shuffle(u)
        assert abs(quality.estimated_prior(p, u) - prior) < 0.06


def test_risk_against_a_plain_loop():
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (40, 3)).astype(np.float32), rng.normal(0, 1, (60, 3)).astype(np.float32)
    for prior in (0.3, 0.9):
        w = np.zeros(4)
        m, v = np.zeros(4), np.zeros(4)
        for t in range(1, 51):
            rows = [(np.append(x, 1), 1) for x in p] + [(np.append(x, 1), 0) for x in u]
            plus, minus, wrong = np.zeros(4), np.zeros(4), 0.0
            for x, kind in rows:
                z, s = x @ w, 1 / (1 + np.exp(-(x @ w)))
                if kind:
                    plus -= prior * (1 - s) * x / 40
                    minus -= prior * s * x / 40
                    wrong -= prior * np.log1p(np.exp(z)) / 40
                else:
                    minus += s * x / 60
                    wrong += np.log1p(np.exp(z)) / 60
            g = plus + minus if wrong >= 0 else -minus
            g[:3] += 1e-4 * w[:3]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        assert np.abs(quality.non_negative_pu(p, u, prior, steps=50) - w).max() < 1e-3


def test_scratch_leaves_results_only(spark, tmp_path):
    import os

    from marlstone.shared import fresh_path, scratch, written

    out = fresh_path(spark, "kept")
    with scratch(spark):
        gone = fresh_path(spark, "gone")
        written(spark.range(5), "mid").write.parquet(gone)
        spark.range(3).write.parquet(out)
    assert not os.path.exists(gone.removeprefix("file://")) and spark.read.parquet(out).count() == 3


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "size", "target", "taken", "copies"]
    kept = out.select(*docs.columns)
    assert kept.join(docs, docs.columns, "left_anti").count() == 0
    texts = [r.text for r in kept.collect()]
    fps = [simhash.fingerprint(t) for t in texts]
    assert all((a ^ b).bit_count() > 4 for a, b in itertools.combinations(fps, 2))
    assert decontaminate.contaminated(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
