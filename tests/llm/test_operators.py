"""Each operator against a brute-force version, an exact round trip or held-out accuracy,
on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import base64
import gzip
import hashlib
import io
import itertools
import json
import random
import math
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telespark.llm import (decontaminate, exact_dedup, factorisation, jaccard_join, line_dedup, packing,
                           secrets, sharding, suffix_dedup, warc)

DOCS = "doc_id long, text string, source string, n_chars long"


def docs(spark, rows, parts=4):
    """Rows of (doc_id, text); columns whose names operators use inside come along."""
    full = [(i, t, "h", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in ("row", "key", "shard", "bucket", "set", "block", "k", "run", "line", "part"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(parts)


EDGE = [(1, None), (2, ""), (3, " \t "), (None, "a b"), (None, "a b"), (4, "a  b"), (4, "a  b"), (5, "x" * 30_000),
        (6, "one"), (7, "ONE ")]


# --- 1 sharding ---------------------------------------------------------------------

@pytest.mark.parametrize("bucket_bytes", [100, 1 << 20])
def test_sharding(spark, bucket_bytes):
    rows = EDGE + [(100 + i, "w" * (i % 50)) for i in range(205)]
    out = sharding.shuffle_to_shards(docs(spark, rows), 8, bucket_bytes=bucket_bytes).collect()
    assert sorted(map(str, ((r.record.doc_id, r.record.text) for r in out))) == sorted(map(str, rows))
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    order = [r.record.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot)) if (r.record.doc_id or 0) >= 100]
    assert order != sorted(order)
    assert sharding.shuffle_to_shards(docs(spark, []), 8).count() == 0


def test_sharding_repeats(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(60)], "doc_id long, text string").coalesce(2)
    a, b = (sorted((r.shard, r.slot, r.record.doc_id) for r in sharding.shuffle_to_shards(df, 3).collect())
            for _ in range(2))
    assert a == b


# --- 2 archives ---------------------------------------------------------------------

def test_warc_round_trip(spark):
    long = "ü" * 200
    rows = [(5, "http://a/é b", long), (2, None, long), (9, "u", long), (2, "again", long), (3, "s", "short"),
            (4, "t", "short"), (None, "n", None), (7, "e", ""), (8, "line\nbreak", "x\r\n\r\ny" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = warc.round_trip(spark, df.repartition(3), with_payload=True).collect()
    want = []
    for i, _, html in rows:
        p = (html or "").encode()
        same = [x for x, _, h in rows if h == html and x is not None]
        refers = min(same) if len(p) >= 100 and i != min(same) else None
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if refers else "response", refers,
                     None if refers else p))
    keys = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    assert sorted(str(tuple(bytes(r[k]) if k == "payload" and r[k] is not None else r[k] for k in keys))
                  for r in got) == sorted(map(str, want))
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    records = [warc.encode_record(i, "u", b"p" * i, hashlib.sha256(b"p" * i).hexdigest(), None) for i in range(4)]
    raw, index, at = io.BytesIO(), [], 0
    for r in records:
        index.append('{"filename": "archive/data.warc.gz", "offset": %d, "length": %d}' % (at, len(r)))
        at += len(r)
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("archive/data.warc.gz", b"".join(records))
        z.writestr("indexes/index.cdxj", "\n".join(index), zipfile.ZIP_DEFLATED)
        z.writestr("pages/pages.jsonl", "{}")
        z.comment = b"a comment"
    assert b"PK\x06\x06" in raw.getvalue()
    source = pa.PythonFile(io.BytesIO(raw.getvalue()), mode="r")
    spans = list(warc.record_ranges(source))
    assert [raw.getvalue()[a:a + n] for a, n in spans] == records
    bad = bytearray(zlib.decompress(records[3], 31))
    bad[-6] ^= 1
    with pytest.raises(ValueError):
        warc.decode_record(warc.gzip.compress(bytes(bad)))


def _foreign_package(path, name, index):
    """A package as other tools write them: a record without page id, digests by SHA-1."""
    payload, at, records = b"<p>elsewhere</p>", 0, []
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload
    for kind, block, mime in (("response", http, "application/http; msgtype=response"),
                              ("resource", payload, "text/html"),
                              ("revisit", http[:-len(payload)], "application/http; msgtype=response")):
        raw = (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://example.com/\r\n"
               f"WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: {mime}\r\n"
               f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
        records.append(raw if name == "other.warc" else gzip.compress(raw))
    lines = []
    for r in records:
        lines.append(f'com,example)/ 20240101000000 {{"url": "http://example.com/{{a b}}", "offset": "{at}", '
                     f'"length": "{len(r)}", "filename": "{name}"}}\n')
        at += len(r)
    text = ("!OpenWayback-CDXJ 1.0\n" + "".join(lines)).encode()
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/" + name, b"".join(records))
        # two gzip members, as block-compressed indexes have
        half = text.index(b"\n", len(text) // 2) + 1
        z.writestr(index, gzip.compress(text[:half]) + gzip.compress(text[half:]) if index.endswith("gz") else text)
        z.writestr("indexes/index.idx", "com,example)/ 20240101000000\tindex.cdx.gz\t0\t10\t1\n")
    return payload


@pytest.mark.parametrize("name,index", [("other.warc.gz", "indexes/index.cdx.gz"), ("other.warc", "indexes/index.cdxj")])
def test_packages_written_elsewhere(spark, tmp_path, name, index):
    payload = _foreign_package(tmp_path / "a.wacz", name, index)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.wacz",)], "path string")
    got = {r.record_type: r for r in warc.read_packages(manifest).collect()}
    assert set(got) == {"response", "resource", "revisit"}
    for kind in ("response", "resource"):
        assert bytes(got[kind].payload) == payload and got[kind].payload_bytes == len(payload)
        assert got[kind].payload_digest == hashlib.sha256(payload).hexdigest()
    assert (got["revisit"].payload, got["revisit"].payload_bytes, got["revisit"].page_id) == (None, None, None)


def test_index_is_in_the_public_form(spark):
    rows = [(i, u, "x" * 10) for i, u in enumerate(("http://b.example.com/Z?q=1 2", None, "u", "http://[broken/"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_packages(warc.page_records(df), warc.folder(spark, "warc")).collect()
    lines = []
    for m in manifest:
        with zipfile.ZipFile(m.path.removeprefix("file:")) as z:
            lines += gzip.decompress(z.read("indexes/index.cdx.gz")).decode().splitlines()
    assert {x.split(" ", 2)[0] for x in lines} == {"com,example,b)/z?q=1%202", "-", "u", "http://[broken/"}
    assert all(set(json.loads(x.split(" ", 2)[2])) >= {"url", "filename", "offset", "length", "digest"} for x in lines)


# --- 3 exact dedup ------------------------------------------------------------------

@pytest.mark.parametrize("fan_in,slice_rows", [(2, 500_000), (8, 3)])
def test_exact_dedup(spark, fan_in, slice_rows):
    rows = EDGE + [(10 + i, f"t{i % 7}") for i in range(40)]
    got = exact_dedup.exact_dedup(docs(spark, rows, 9), fan_in=fan_in, slice_rows=slice_rows).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == sorted(map(str, want))
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("fan_in", [0, 1, 3, 6])
def test_fan_in_is_a_power_of_two(spark, fan_in):
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs(spark, EDGE), fan_in=fan_in)


def _packed_runs(runs):
    tables = [exact_dedup._make_run((pa.scalar(0), pa.scalar(i)), pa.table({
        "key": pa.array([r[0] for r in run], pa.binary()), "id": pa.array([r[1] for r in run], pa.int64()),
        "rid": pa.array([r[2] for r in run], pa.int64()), "n": pa.array([r[3] for r in run], pa.int64())}))
        for i, run in enumerate(runs)]
    return pa.concat_tables(tables)


def _random_runs(rng, runs, rows, keys):
    out, rid = [], 0
    for _ in range(runs):
        run = []
        for key in rng.choice(keys, rows, replace=False):
            # keys that end in zero bytes, null and equal identifiers
            name = int(key).to_bytes(8, "big") + b"\0" * 40
            run.append((name, None if rng.random() < 0.1 else int(rng.integers(-5, 5)), rid, int(rng.integers(1, 9))))
            rid += 1
        out.append(run)
    return out


def test_packed_runs_merge():
    rng = np.random.default_rng(5)
    runs = _random_runs(rng, 7, 300, 500)
    want = {}
    for key, id_, rid, n in (r for run in runs for r in run):
        best, total = want.get(key, ((True, 0, rid), 0))
        want[key] = (min(best, (id_ is None, id_ or 0, rid)) if total else (id_ is None, id_ or 0, rid), total + n)
    table = _packed_runs(runs)
    root = exact_dedup._merge_root((pa.scalar(0), pa.scalar(0)), table).to_pylist()
    assert [r["key"] for r in root] == sorted(want)
    assert all(((r["id"] is None, r["id"] or 0, r["rid"]), r["n"]) == want[r["key"]] for r in root)
    # the same through two levels
    key = (pa.scalar(0), pa.scalar(0))
    halves = pa.concat_tables([exact_dedup._merge_runs(key, table.slice(0, 4)),
                               exact_dedup._merge_runs(key, table.slice(4))])
    assert exact_dedup._merge_root(key, halves).to_pylist() == root


def test_merge_is_linear_in_rows():
    class Key:
        seen = 0

        def __init__(self, v):
            self.v = v

        def __lt__(self, other):
            Key.seen += 1
            return self.v < other.v

        def __eq__(self, other):
            Key.seen += 1
            return self.v == other.v

    def comparisons(rows):
        rng, Key.seen = np.random.default_rng(rows), 0
        runs = [[(Key(int(v)), 0, 0, 0, 1) for v in sorted(rng.integers(0, 1 << 40, rows))] for _ in range(8)]
        assert sum(e[4] for e in exact_dedup.merge_heads(map(iter, runs))) == 8 * rows
        return Key.seen / (8 * rows)

    small, large = comparisons(250), comparisons(8_000)
    assert large < 1.05 * small and large < 4 * (math.log2(8) + 1)


# --- 4 classifier -------------------------------------------------------------------

def test_factorisation_identity():
    rng = np.random.default_rng(1)
    model = factorisation.Model(0.3, rng.normal(size=factorisation.SIZE),
                                rng.normal(size=(factorisation.SIZE, factorisation.FACTORS)))
    index, x = np.array([3, 70, 500, 16_390]), np.array([0.5, 1.0, 2.0, 1.0])
    pairs = sum(model.v[index[a]] @ model.v[index[b]] * x[a] * x[b] for a, b in itertools.combinations(range(4), 2))
    assert model.raw(index, x) == pytest.approx(0.3 + model.w[index] @ x + pairs)


def test_classifier_held_out_accuracy(spark, prose):
    rng = random.Random(2)
    rows, labels = list(EDGE), []
    for i in range(100, 500):
        good = rng.random() < 0.6
        words = prose(rng, 60)
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:15] * 4)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    df = docs(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = factorisation.train_on(df, lab)
    out = {r.row.doc_id: r.score for r in factorisation.score(df, model, keep=[F.col("doc_id")]).collect()}
    test = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(0 <= s <= 1 for s in out.values())
    assert sum((out[i] >= factorisation.THRESHOLD) == bool(q) for i, q in test) >= 0.95 * len(test)
    none = factorisation.train_on(df, lab.limit(0))
    assert {r.score for r in factorisation.score(df, none).collect()} == {0.5}
    assert factorisation.score(docs(spark, []), model).count() == 0


# --- 5 suffixes ---------------------------------------------------------------------

def brute_removals(rows):
    texts = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in texts:
        for p in range(len(b) - 99):
            first[b[p:p + 100]] = min(first.get(b[p:p + 100], (d, p)), (d, p))
    out = []
    for (doc, _), (d, b) in zip(rows, texts):
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p:p + 100]] < (d, p):
                gone[p:p + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot_rows,run_bytes", [(suffix_dedup.HOT_ROWS, suffix_dedup.RUN_BYTES), (3, 2000)])
def test_suffix_dedup(spark, prose, monkeypatch, hot_rows, run_bytes):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 4000)
    rng = random.Random(7)
    passages = [" ".join(prose(rng, 40)) for _ in range(4)]
    rows = [r for r in EDGE if r[0] is not None and r[0] != 5] + [(5, "x" * 400), (None, passages[0])]
    for i in range(80):
        text = " ".join(prose(rng, rng.randint(0, 50)))
        if rng.random() < .6:
            text += rng.choice(passages)[rng.randint(0, 30):] + " ".join(prose(rng, 20))
        if rng.random() < .2:
            text += text
        if rng.random() < .1:
            text = "ab " * rng.randint(20, 150)
        rows.append((1000 - i, text))
    got = suffix_dedup.removals(docs(spark, rows), hot_rows=hot_rows, run_bytes=run_bytes).drop("kept")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_removals(rows)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.removals(docs(spark, [])).count() == 0


def test_merge_runs_order_and_prefixes(prose):
    rng = random.Random(3)
    for runs in (1, 2, 5, 8):
        texts = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode()
                        for _ in range(rng.randint(0, 12))) for _ in range(runs)]
        shared = [[0] + [suffix_dedup.common_prefix(a, b) for a, b in zip(t, t[1:])] for t in texts]
        order, prefixes = suffix_dedup.merge_runs([(t, s[:len(t)]) for t, s in zip(texts, shared)])
        out = [texts[r][i] for r, i in order]
        assert out == sorted(x for t in texts for x in t)
        assert prefixes[1:] == [suffix_dedup.common_prefix(a, b) for a, b in zip(out, out[1:])]
    run = [(b"abc", b"z", (1, 2, 3, 1, 1)), (b"abd", b"", (1, 2, 9, 0, 1))]
    back = suffix_dedup.decode_run(suffix_dedup.encode_run(run))
    assert back[0] == [b"abc", b"abd"] and back[1] == [0, 2] and back[3] == b"z"


# --- 6 Jaccard join -----------------------------------------------------------------

def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    forest = jaccard_join.Forest(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                forest.join(i, j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(forest.find(i), []).append(d)
    return sorted(str((d, len(sets[i]), min((x for x in ids[forest.find(i)] if x is not None), default=None)))
                  for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("n,num,den,tile", [(3, 90, 100, jaccard_join.TILE), (5, 8, 10, 500), (1, 1, 2, 300)])
def test_jaccard_join(spark, prose, n, num, den, tile):
    rng = random.Random(4)
    bases, passage = [prose(rng, k) for k in (3, 6, 12, 25, 60, 150) for _ in range(4)], prose(rng, 30)
    rows = list(EDGE)
    for i in range(200):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = prose(rng, 1)[0]
        if rng.random() < .3:
            w = prose(rng, 60) + passage
        rows.append((100 + i * 7 % 200, " ".join(w)))
    out = jaccard_join.component_ids(jaccard_join.similar_components(docs(spark, rows), n=n, num=num, den=den, tile=tile))
    got = sorted(str((r.id, r.size, r.component_id)) for r in out.collect())
    assert got == brute_components(rows, n, num, den)


def test_linkable_takes_sets_of_any_size(spark):
    # at 90/100 size class 128 begins at 729,149 shingles
    rows = [(1, 1, 1, 800_000, 1, 2, [7, 8]), (2, 2, 2, 880_000, 2, 2, [7, 8]),      # neighbouring classes
            (3, 3, 3, 2_000_000_000, 3, 1, [9]), (4, 4, 4, 5, 4, 1, [10]), (5, 5, 5, 800_000, 5, 80_001, list(range(100, 80_101)))]
    df = spark.createDataFrame(rows, "row long, id long, text_key long, size long, set long, tested int, low array<long>")
    assert sorted(r.id for r in jaccard_join.linkable(df, 90, 100).collect()) == [1, 2, 3]
    assert sorted(r.id for r in jaccard_join.linkable(df, 9999, 10000).collect()) == [1, 2, 3]


def test_keep_one(spark):
    rows = EDGE + [(20, "p q r s t u"), (21, "p q r s t u"), (21, "p q r s t u"), (22, "alone here now we are")]
    df = docs(spark, rows)
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    # wordless texts all stay; "a b" and "a  b" are one group, "one" and "ONE " another
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 4, 5, 6, 20, 22]))
    assert jaccard_join.keep_one(docs(spark, [])).count() == 0


# --- 7 secrets ----------------------------------------------------------------------

def brute_findings(text):
    text, found = text or "", []
    assign = r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for rank, (kind, pattern, group, least) in enumerate((("assign", assign, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20),
                                                          ("hex", r"[0-9a-f]+", 0, 24))):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                found.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


SECRETS = [(1, "é password=abcdef12 Token: 'x' API_KEY=\"ZZZZZZ\" secret:token:abcdefgh"), (2, None), (3, ""),
           (4, "AKIA" + "A" * 16 + " AKIAshort AKIAAKIA" + "Z9" * 8), (5, "x" + "0af" * 10 + "g" + "1" * 24),
           (6, "token=token=abcdef\npasswd='0123456789abcdef0123456789'"), (7, "\U0001f600 apikey = ABCDEF"),
           (None, "secret=hunter22"), (None, "secret=hunter22"), (8, "secret=hunter22"), (9, "ſecret=abcdefgh")]


def test_secret_spans(spark):
    out = secrets.scan(docs(spark, SECRETS)).select("path", secrets.joined(F.col("findings")).alias("s"))
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(str((i, brute_findings(t))) for i, t in SECRETS)
    assert secrets.scan(docs(spark, [])).count() == 0


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first, more = docs(spark, SECRETS[:6]), docs(spark, SECRETS)
    assert secrets.update_ledger(first, path) == 3 * 5          # null and empty are one blob
    assert secrets.update_ledger(first, path) == 0
    assert secrets.update_ledger(more, path) == 3 * 3
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, r"[0-9a-f]{30,}"))
    assert secrets.update_ledger(more, path, newer) == 8
    got = secrets.findings(more, secrets.open_ledger(spark, path), newer).where("path = 5").first()
    assert [(x.start, x.end) for x in got.findings] == [(1, 31)]


def test_pairs_appended_twice_count_once(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = docs(spark, SECRETS)
    once = [r for r in secrets.scan(rows, ledger_path=path).collect()]
    spark.read.parquet(path).write.mode("append").parquet(f"{path}-copy")
    spark.read.parquet(f"{path}-copy").write.mode("append").parquet(path)      # every pair a second time
    assert secrets.update_ledger(rows, path) == 0
    again = secrets.findings(rows, secrets.open_ledger(spark, path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, once)) and any(r.findings for r in once)


# --- 8 decontamination --------------------------------------------------------------

def test_masks_hit_every_window_with_two_substitutions():
    for bad in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(all(s + o not in bad for o in mask) for mask in decontaminate.MASKS
                   for s in range(decontaminate.WINDOW - decontaminate.SPAN + 1))


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_SEEDS, 0])
def test_contaminations(spark, prose, limit):
    rng = random.Random(6)
    items = [(i, " ".join(prose(rng, 20))) for i in range(5)] + [(90, None), (91, "too short an item")]
    rows = list(EDGE)
    for i in range(60):
        w = prose(rng, rng.randint(0, 60))
        if rng.random() < .5:
            part = items[rng.randrange(5)][1].split()[rng.randint(0, 10):]
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = "zzz"
            at = rng.randint(0, len(w))
            w[at:at] = part
        rows.append((100 + i, " ".join(w).upper() if i % 2 else ", ".join(w)))

    def tokens(t):
        return [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    want = set()
    for d, t in rows:
        a = tokens(t)
        for item, u in items:
            b = tokens(u)
            for i in range(len(a) - 11):
                for j in range(len(b) - 11):
                    if sum(x == y for x, y in zip(a[i:i + 12], b[j:j + 12])) >= 10:
                        want.add((d, item))
    df, bench = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminations(df, bench, broadcast_seeds=limit)
    assert {(r.doc, r.item) for r in got.collect()} == want
    clean = decontaminate.decontaminate(df, bench)
    bad = {d for d, _ in want}
    assert clean.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(d) for d, _ in rows if d not in bad)
    assert decontaminate.contaminations(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_SEEDS, 0])
def test_short_and_unspaced_items(spark, limit):
    eleven = "who wrote the first long novel in that old river town"
    items = [(1, eleven), (2, "Paris"), (3, "今天天气很好我们去公园散步"), (4, "東京タワーはどこ"), (5, "ภาษาไทยง่าย"), (6, "Paris"),
             (7, "in that"), (None, "only null"), (8, " .,"), (9, None)]
    rows = [(10, f"Q: {eleven.upper()}? A: paris."), (11, eleven.replace("novel", "story")), (12, "parish in that"),
            (13, "前言今天天气很好,我们去公园走步后记"), (14, "今天天气不好"), (15, "x東京タワーはどこですか"), (16, "東京タワー"),
            (17, "เรียนภาษาไทยง่ายมาก"), (18, "only null only null"), (19, None), (20, ""), (21, eleven[4:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminations(docs(spark, rows), bench, broadcast_seeds=limit).collect()
    assert sorted((r.doc, str(r.item), r.best, r.start) for r in got) == sorted([
        (10, "1", 11, 1), (10, "2", 1, 13), (10, "6", 1, 13), (10, "7", 2, 7), (11, "7", 2, 6), (12, "7", 2, 1),
        (13, "3", 11, 2), (15, "4", 8, 1), (17, "5", 10, 4), (18, "None", 2, 0), (21, "7", 2, 5)])
    clean = decontaminate.decontaminate(docs(spark, rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [14, 16, 19, 20]


# --- 9 lines ------------------------------------------------------------------------

def test_line_dedup(spark):
    rows = [(i, "a", f"menu\nbody {i}\n\n menu \t\nfoot") for i in range(10)]
    rows += [(20 + i, "b", f"menu\nonly {i}") for i in range(4)] + [(30, None, "menu"), (31, "a", None), (32, "a", "")]
    rows += [(40, "c", "same\nsame")] * 8
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("host", F.lit("x"))
    out = {r.row.doc_id: r.line_dedup for r in line_dedup.drop_lines(df.repartition(3), max_ratio=0.5).collect()}
    assert out[3].text == "body 3\n" and (out[3].n_lines, out[3].n_dropped) == (5, 3)
    assert out[21].text == "only 1"                # on all four pages of the host
    assert out[30].text == "menu" and out[31].text is None and out[31].n_lines == 0 and out[32].text == ""
    assert out[40].text == ""                      # every copy is a page
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_line_dedup_counts_rows(spark):
    """A menu on 600 copies of 1,000 pages goes, a line on five pages stays; a host of three pages
    loses its menu, one of a single page nothing."""
    rows = [(i, "big", "menu\ncopy" if i < 600 else f"body {i}" + ("\nfive" if i < 605 else "")) for i in range(1000)]
    rows += [(2000 + i, "small", f"menu\nbody {i}") for i in range(3)] + [(3000, "one", "menu\nmenu"), (3001, "one", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    out = {r.row.doc_id: r.line_dedup for r in line_dedup.drop_lines(df).collect()}
    assert out[0].text == "" and out[602].text == "body 602\nfive" and out[700].text == "body 700"
    assert out[2001].text == "body 1" and out[3000].text == "menu\nmenu"


# --- 10 packing ---------------------------------------------------------------------

def test_plan_is_minimal_on_small_cases():
    assert packing.plan({6: 2, 4: 2}, 10) == [([(6, 1), (4, 1)], 2)]
    assert sum(n for _, n in packing.plan({5: 4, 3: 4, 2: 4}, 10)) == 4
    rng = random.Random(8)
    for _ in range(30):
        stock = {rng.randint(1, 20): rng.randint(1, 30) for _ in range(8)}
        combos = packing.plan(stock, 20)
        used = {}
        for use, bins in combos:
            assert sum(length * n for length, n in use) <= 20 and bins > 0
            for length, n in use:
                used[length] = used.get(length, 0) + n * bins
        assert used == stock and len(combos) <= len(stock) * 2


def test_packing(spark, prose):
    from tokenizers import Tokenizer
    rng = random.Random(9)
    rows = EDGE + [(100 + i, " ".join(prose(rng, rng.choice([0, 3, 40, 300])))) for i in range(60)]
    rows += [(50, "it's 12 €uro\n\n  x <|endoftext|> 你好")]
    out = packing.pack(docs(spark, rows), capacity=128).collect()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 128 + 1
        cuts = [0, *range(first, len(ids), 128), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in out) == sorted(map(str, want))
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 128
    assert len(bins) <= 1.05 * sum(r.length for r in out) / 128 + 1
    assert packing.pack(docs(spark, [])).count() == 0
