import hashlib
import math
import random
import re
import time

from passagemill.llm import pii

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def found(frame):
    return {r["doc_id"]: ([tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in pii.find(frame).collect()}


ODD = [
    None, "", "a@b.c_x@d.e a@b a@b.c@d.e.f", "é😀 jo.e+1@x-y.co.uk.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0004 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112; 4111 1111 1111 1111 5", "+1 (555) 010-9999 +12345678 +1 2", "+49 30 123456\n+49\n30123456", "9" * 5000,
    "x" * 20000 + "@", "1 " * 3000, "+" + "1(" * 3000 + "1", "me@x.org,you@y.org;4111111111111111",
]


def test_base_spans_against_brute_force(spark, sf):
    rows = [(i, t, "k") for i, t in enumerate(ODD)] + [(1000 + r["doc_id"], r["text"], "k") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = found(docs)
    assert {k: v[0] for k, v in got.items()} == {i: brute(t) for i, t, _ in rows}
    out = {r["doc_id"]: r for r in pii.digests(pii.find(docs)).collect()}
    for i, t, _ in rows:
        said = ",".join(":".join(map(str, s)) for s in brute(t))
        assert out[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in brute(t)) for k in KINDS]


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"Some words. Please call us on +1 555 010 {1000 + i} today") for i in range(12)]
    rows += [(100, "Hi, please call us on (555) 010-7777 now."), (101, "The lot number reads (555) 010-7778 now."), (102, "call us on 5550107777"), (102, "call us on 5550107777")]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[100] == ([], [("phone", 22, 36)]) and got[101] == ([], []) and got[102][1] == [("phone", 11, 21)]
    few = found(spark.createDataFrame(rows[:3] + rows[12:13], "doc_id long, text string"))
    assert few[100] == ([], [])  # three seeds are no evidence


def contexts(text):
    """Seeds and candidates with the two words before them, by the definitions of the module."""
    base = brute(text)
    masked = list(text)
    for _, a, b in base:
        masked[a:b] = "\0" * (b - a)
    out = [(k, text[a:b].lower(), text[max(0, a - 64) : a], True, a, b) for k, a, b in base]
    for m in re.finditer(r"(?<![A-Za-z0-9.+\x00-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![A-Za-z0-9\x00])", "".join(masked)):
        n = len(re.sub("[^0-9]", "", m[0]))
        kind = "ip" if re.fullmatch(r"\(?[0-9]{1,3}(?:\.[0-9]{1,3}){3}", m[0]) else "card" if 13 <= n <= 19 else "phone" if 7 <= n <= 12 else None
        if kind:
            out.append((kind, m[0].lower(), "".join(masked)[max(0, m.start() - 64) : m.start()], False, m.start(), m.end()))
    words = lambda s: re.findall(r"[^\W\d_]+", s.lower())
    return [(k, v, " ".join(words(c)[-2:]) if len(words(c)) > 1 else None, seed, a, b) for k, v, c, seed, a, b in out]


def graph_scores(texts):
    """What is found in each text beside the base spans, by plain loops over the whole graph."""
    seen = [(i, *x) for i, t in enumerate(texts) for x in contexts(t)]
    edges, docs, seeds = {}, {}, set()
    for i, k, v, c, seed, _, _ in seen:
        if c is not None:
            edges.setdefault((k, c), {}).setdefault(v, False)
            edges[k, c][v] |= seed
            docs.setdefault((k, c), set()).add(texts[i])
    edges = {p: e for p, e in edges.items() if len(docs[p]) >= pii.MIN_DOCUMENTS}
    belief = {(p, v): float(seed) for p, e in edges.items() for v, seed in e.items()}
    for _ in range(pii.ROUNDS):
        good = {}
        for p, e in edges.items():
            believed = sum(belief[p, v] for v in e)
            share = believed / len(e)
            if believed >= pii.MIN_INSTANCES - 1e-9 and share >= pii.MIN_CONFIDENCE and share * math.log2(believed + 1) >= pii.MIN_SCORE:
                good[p] = share
        for (p, v), _ in belief.items():
            doubt = math.prod(max(1 - s, 1e-9) for q, s in good.items() if q[0] == p[0] and v in edges[q])
            belief[p, v] = 1.0 if edges[p][v] else 1 - doubt
    return [{(k, a, b) for j, k, v, c, seed, a, b in seen if j == i and not seed and (k, c) in good} for i in range(len(texts))]


def test_graph_scores_against_brute_force(spark):
    rng = random.Random(11)
    cues = ["call us on", "my number is", "ring me at", "lot number", "order was", "the card is", "server is at"]
    make = {
        "seed": lambda: rng.choice([f"+1 555 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}", "4111 1111 1111 1111", f"10.0.{rng.randrange(255)}.{rng.randrange(255)}"]),
        "open": lambda: rng.choice([f"(555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}", f"555 {rng.randrange(1000, 1030)}", f"{rng.randrange(10**15, 10**16)}", f"10.1.2.{rng.randrange(256, 999)}"]),
    }
    texts = []
    for i in range(260):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(cues))
            parts.append(f"so {cues[k]} {make['seed' if rng.random() < (0.9, 0.7, 0.5, 0.1, 0.3, 0.6, 0.8)[k] else 'open']()}")
        texts.append(", ".join(parts) + f" end {i % 200}")
    want = graph_scores(texts)
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {i: set(spans) - set(base) for i, (base, spans) in got.items()} == dict(enumerate(want))
    assert 20 < sum(map(len, want)) < 400


def test_time_of_a_text_with_many_spans(spark):
    text = " ".join(f"é me{i}@x{i}.org +1 555 010 {1000 + i % 9000}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.digests(pii.find(docs)).first()
    assert (row["n_email"], row["n_phone"]) == (20_000, 20_000)
    assert pii.redact(docs).first()["text"] == " ".join(["é [EMAIL] [PHONE]"] * 20_000)
    assert time.time() - began < 60


def test_redact_keeps_columns_and_the_rest(spark):
    rows = [(1, "é a@b.c, 4111111111111111 b", "h", "m"), (2, None, "h", "m"), (3, "+1.2.3.4.56789 x", "h", "m"), (4, "clean", None, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, spans string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: "é [EMAIL], [CARD] b", 2: None, 3: "[PHONE] x", 4: "clean"}
    assert pii.redact(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for frame in (pii.find(docs), pii.redact(docs)):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().toString())
