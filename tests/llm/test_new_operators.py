"""Personal data, fill-in-middle and vector codes against brute-force versions."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from telespark.llm import catalog, codebooks, infill, packing, personal, store

SF = "/root/testdata/sf0.001"


def table(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "findings", "output", "form", "t", "i", "kind"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(parts)


# --- 11 personal data ---------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", r"\x20\-"), "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    """The patterns as they are written, with the checks after them."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 13 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_on_random_texts():
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", ".", "x@y.z", "_", "-", " ", "  ", "+", "1", "25", "255", "256", "0001", "4111111111111111",
              "4111 1111 1111 1111", "378282246310005", "+1 (017) 555-7713", "+", "(", ")", "é", "1.2.3.4", "\n", "%", "😀"]
    detector = personal.Detector()
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        found = detector.find(text)
        assert [f"{f.kind}:{f.start}:{f.end}" for f in found if f.base] == base_spans(text), text


@pytest.mark.parametrize("text,spans", [
    ("to 4111111111111111 5500005555555559 end", ["card_part:3:19", "card_part:20:36"]),
    ("card 12 3782 822463 10005 7", ["card_part:8:25"]),
    ("IBAN DE89 3704 0044 0532 0130 00 AND MORE", ["iban:5:32"]),
    ("DE89370400440532013000 GB82WEST12345698765432", ["iban:0:22", "iban:23:45"]),
    ("DE89370400440532013001", []),
    ("ssn 078-05-1120", ["ssn:4:15"]), ("part 078-05-1120", []), ("ssn 666-05-1120", []),
])
def test_added_kinds(text, spans):
    assert [f"{f.kind}:{f.start}:{f.end}" for f in personal.Detector().find(text)] == spans


def test_context_moves_scores():
    score = {text: personal.Detector().find(text)[0].score for text in
             ("at 10.0.0.1", "server 10.0.0.1", "version 10.0.0.1")}
    assert score["version 10.0.0.1"] < score["at 10.0.0.1"] < score["server 10.0.0.1"] <= 1


def test_long_runs_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1 " * 200_000, "+1" + "(" * 400_000, "1." * 200_000, "@" * 400_000,
                 "a@b.c" * 80_000):
        personal.Detector().find(text)


def test_mask():
    text = "mail a@b.cd, ip 1.2.3.4 +1 (017) 555-7713"
    assert personal.mask(text, personal.Detector().find(text)) == "mail [EMAIL], ip [IP] [PHONE]"
    text = "+4111111111111111"           # a card inside; too many digits for a phone
    assert personal.mask(text, personal.Detector().find(text)) == "+[CARD]"


def test_detect_edges(spark):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (None, "a@b.c"), (3, "x" * 100_000 + " a@b.c"), (4, "1.2.3.4")]
    got = personal.detect(table(spark, rows), with_masked=True).collect()
    want = {None: ["email:0:5"], 1: [], 2: [], 3: ["email:100001:100006"], 4: ["ip:0:7"]}
    assert len(got) == len(rows)
    for r in got:
        assert [f"{f.kind}:{f.start}:{f.end}" for f in r.findings] == want[r.row.doc_id]
        assert (r.masked is None) == (r.row.text is None)
    assert personal.detect(table(spark, [])).count() == 0


def test_op11_query(spark):
    texts = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in catalog.queries()["op11_personal_data"](spark, SF).collect()}
    assert len(got) == len(texts)
    for row in texts:
        want, r = base_spans(row["text"] or ""), got[row["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PLAIN]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in PLAIN] == want
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.values()) > 0


# --- 12 fill-in-middle --------------------------------------------------------------

def test_rotation():
    rng = random.Random(1)
    for size in (0, 1, 2, 7, 200_000):
        data = bytes(rng.randrange(256) for _ in range(size))
        for _ in range(5):
            a, b, c = sorted(rng.randint(0, size) for _ in range(3))
            out = bytearray(data)
            infill.rotate(out, a, b, c)
            assert bytes(out) == data[:a] + data[b:c] + data[a:b] + data[c:]


def plain_infill(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a", "é", "\n", "😀", "<", "<S", ">", "P>", "\r", " ", " "])
                        for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(None, "a\nb"), (None, "a\nb"), (1, None), (2, ""), (3, "\n"), (4, "x <M> y\nz"), (5, "line\n" * 50_000)]
    made = infill.fill_in_middle(table(spark, rows), keep=[F.col("doc_id"), F.col("text")])
    got = made.collect()
    assert sorted(str((r.row.doc_id, r.row.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) \
        == sorted(str((i, t, *plain_infill(i, t))) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    back = infill.restored(made, [F.col("row.text").alias("was")]).collect()
    assert len(back) == len(rows) and all(r.text == (r.row.was or "") for r in back)
    assert infill.fill_in_middle(table(spark, [])).count() == 0
    none = infill.fill_in_middle(table(spark, rows), rate=0).select("form").distinct().collect()
    assert [r.form for r in none] == ["plain"]


def test_op12_query(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in catalog.queries()["op12_fill_in_middle"](spark, SF).collect()}
    assert len(got) == len(rows)
    for row in rows:
        n, form, p, m, out = plain_infill(row["doc_id"], row["text"])
        r = got[row["doc_id"]]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((row["text"] or "").encode()).hexdigest()


# --- 13 vector codes ----------------------------------------------------------------

def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Every part against every entry; rows of (id, vector, label) in the order of ids."""
    kept = [(i, [math.floor(1024 * x) for x in v], g) for i, v, g in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return [], []
    d = len(kept[0][1]) // parts
    x = np.array([r[1] for r in kept], np.int64).reshape(len(kept), parts, d)
    books = [x[:entries, p].copy() for p in range(parts)]

    def assign():
        dist = [((x[:, p, None, :] - books[p][None]) ** 2).sum(-1) for p in range(parts)]
        return [a.argmin(1) for a in dist], [a.min(1) for a in dist]
    for _ in range(rounds):
        index, _ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                if (index[p] == e).any():
                    books[p][e] = x[index[p] == e, p].sum(0) // (index[p] == e).sum()
    index, dist = assign()
    return [(r[0], [int(index[p][k]) for p in range(parts)], int(sum(dist[p][k] for p in range(parts))), r[2])
            for k, r in enumerate(kept)], books


@pytest.mark.parametrize("most,kind", [(3, "ties"), (1 << 10, "doubles"), (1 << 27, "integers")])
def test_equal_average_search(most, kind):
    rng = np.random.default_rng(4)
    for d, n in ((1, 1), (3, 40), (16, 256)):
        entries = rng.integers(-most, most + 1, (n, d))
        parts = np.concatenate([rng.integers(-most, most + 1, (1300, d)), entries])
        index, best = codebooks.Codebook(entries).nearest(parts)
        dist = ((parts[:, None, :] - entries[None]) ** 2).sum(-1)
        assert (index == dist.argmin(1)).all() and (best == dist.min(1)).all()


def vectors(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumn("row", F.lit(1)).withColumn("codes", F.lit(2)).repartition(parts)


def coded(spark, rows):
    got = codebooks.prepared(vectors(spark, rows), keep=[F.col("vec_id"), F.col("label")])
    books = codebooks.train(got)
    return sorted(((r.row.vec_id, r.codes, r.error, r.row.label) for r in codebooks.compress(got, books).collect()),
                  key=str), books


def test_codes_against_all_pairs(spark):
    rng = random.Random(6)
    hot = [rng.randint(-3, 3) / 8 for _ in range(8)]
    rows = [(i, hot if i % 3 == 0 else [np.float32(rng.gauss(0, 1)).item() for _ in range(8)], i % 4 or None)
            for i in range(900)]
    rows += [(9000, None, 1), (9001, [1.0] * 7 + [None], 1), (9002, [float("nan")] * 8, 2), (9003, [float("inf")] * 8, 2),
             (None, [0.5] * 8, 3), (None, [0.25] * 8, 3), (7, [0.1] * 8, 3), (9004, [50_000.0] * 8, 1)]
    rows = [(i, v and [None if x is None else np.float32(x).item() for x in v], g) for i, v, g in rows]
    got, books = coded(spark, rows)
    want, plain = plain_codes(rows)
    assert got == sorted(want, key=str)
    assert all((a == b).all() for a, b in zip(books, plain))
    assert codebooks.decompress(got[0][1], books) == [x / 1024 for b, c in zip(plain, got[0][1]) for x in b[c]]


def test_codes_of_few_odd_and_no_rows(spark):
    got, books = coded(spark, [(2, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.5], 1), (3, [], 1), (4, [1.0], 2)])
    assert [g[0] for g in got] == [1, 2] and books[0].shape == (2, 1) and [g[2] for g in got] == [0, 0]
    assert coded(spark, [])[0] == []


def test_group_sums_beyond_a_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 40, i) for i in range(600)], "id long, g int, v long")
    want = {}
    for i in range(600):
        g = None if i % 3 == 0 else i % 40
        want[g] = want.get(g, 0) + i
    for most in (1_000_000, 0):
        monkeypatch.setattr(codebooks, "BROADCAST_ROWS", most)
        got = codebooks.with_group_sum(rows, "g", "v", "total").collect()
        assert len(got) == 600 and all(r.total == want[r.g] for r in got)


def test_op13_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    want, books = plain_codes(rows)
    sums = {}
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    text = ",".join(str(x) for b in books for x in b.ravel().tolist())
    got = catalog.queries()["op13_vector_codes"](spark, SF).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted(
        (i, "".join(f"{c:02x}" for c in code), error, sums[label]) for i, code, error, label in want)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


# --- memory of workers, pieces of the tokenizer -------------------------------------

def test_simple_pattern_equals_the_vocabulary_pattern():
    import regex
    plain, simple = regex.compile(packing.PIECE_PATTERN).findall, packing.simple_pattern().findall
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x250)] + list(" '  \n\t") * 20 + list("stmdrevl'") * 10
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        assert simple(text) == plain(text), repr(text)


def test_encoder_generations(monkeypatch, prose):
    """A memory of a few pieces that turns over all the time gives the tokenizer's ids."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    encoder = packing.Encoder(packing.default_tokenizer())
    rng = random.Random(9)
    for _ in range(60):
        text = rng.choice(["", "\n", "  "]).join(w + rng.choice([" ", ", ", "'s ", "1 "]) for w in prose(rng, 40)) + rng.choice(["", "漢字"])
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want
        assert len(encoder.known) <= 10 + 200


def test_encoder_learns_by_groups(monkeypatch, prose):
    """Texts share the calls of the tokenizer and keep their ids and order; a group ends at a size."""
    monkeypatch.setattr(packing, "GROUP_CHARS", 2_000)
    encoder = packing.Encoder(packing.default_tokenizer())
    rng, learned, learn = random.Random(10), [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: learned.append(len(words)) or learn(words))
    texts = [" ".join(prose(rng, 12)) + rng.choice(["", " caf\u00e9 na\u00efve", " \u6f22\u5b57", "\n"]) for _ in range(200)] + [""]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_all(texts)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert 1 < len(learned) < 50


def test_worker_keeps_one_operator(monkeypatch):
    monkeypatch.setattr(store, "_held", {})
    made = []
    one = store.tidy(lambda batches: iter([store.held("a", lambda: made.append("a") or 1)]), "a")
    other = store.tidy(lambda batches: iter([2]))
    assert [*one([]), *one([])] == [1, 1] and made == ["a"]
    assert [*other([])] == [2] and store._held == {}
    assert [*one([])] == [1] and made == ["a", "a"]
