import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from tracemill.llm import pii

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base(text):
    return [(k, m.start(), m.end(), m.group()) for k, p in RAW.items() for m in re.finditer(p, text) if valid(k, m.group())]


def brute(rows, disclosure=pii.DISCLOSURE, least=pii.LEAST_DOCS):
    both, entity, near, df = Counter(), Counter(), [], Counter()
    for n, (_, text) in enumerate(rows):
        text = text or ""
        df.update({w.lower() for w in re.findall(r"[^\W\d_]+", text)})
        found = defaultdict(list)
        for s in base(text):
            found[s[0]].append(s)
        seen, pairs = set(), set()
        for kind in RAW:
            ends = [m.end() for m in re.finditer(RAW[kind], text) if kind != "card" or 13 <= len(re.sub("[^0-9]", "", m.group())) <= 19]
            starts = [m.start() for m in re.finditer(RAW[kind], text) if kind != "card" or 13 <= len(re.sub("[^0-9]", "", m.group())) <= 19]
            for _, s, e, v in found[kind]:
                left, right = max([0, *[x for x in ends if x <= s]]), min([len(text), *[x for x in starts if x >= e]])
                words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]+", text)]
                clip = lambda a, b, lo, hi: [(max(x, lo), min(y, hi), text[max(x, lo) : min(y, hi)].lower()) for x, y, w in words if y > lo and x < hi]
                low, high = (s - 100 if s - left > 100 else left), (e + 100 if right - e > 100 else right)
                pre = [w for w in clip(0, 0, low, s) if not (s - left > 100 and w[0] == low)][-5:]
                post = [w for w in clip(0, 0, e, high) if not (right - e > 100 and w[1] == high)][:5]
                name = f"{kind}:{v.lower()}"
                seen.add(name)
                for w in pre + post:
                    pairs.add((name, w[2]))
                    near.append((n, name, *w))
        entity.update(seen)
        both.update(pairs)
    total = len(rows)
    ok = {p for p, c in both.items() if c >= least and entity[p[0]] < total and math.log(c * total / (df[p[1]] * entity[p[0]])) >= disclosure * math.log(total / entity[p[0]]) - 1e-12}
    out = []
    for n, (i, text) in enumerate(rows):
        own = base(text or "")
        terms = sorted({(s, e) for m, name, s, e, w in near if m == n and (name, w) in ok and not any(s < b[2] and e > b[1] for b in own)})
        listed = [f"{k}:{s}:{e}" for k, s, e, _ in own]
        count = Counter(k for k, *_ in own)
        out.append((i, *(count[k] for k in RAW), len(terms), hashlib.sha256(",".join(listed).encode()).hexdigest(), ",".join(listed + [f"term:{s}:{e}" for s, e in terms])))
    return sorted(out, key=str)


def report(frame, **kw):
    return sorted(map(tuple, pii.span_report(pii.find_spans(frame, **kw)).collect()), key=str)


def test_spans_against_brute_force(spark):
    rng = random.Random(11)
    bits = ["a@b.c", "a.b@", "@x", "1.2.3.4", "256.1.1.1", "0001.02.3.4.5.6.7", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "+", "1", " ", "-", ".", "é", "Wort", "x_y@q-r.s.t", "+12345678", "12 ", "\n", "_", "%", "(", "9" * 14]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))) for i in range(600)]
    rows += [(700, None), (701, ""), (None, "mail a@b.c now"), (5, rows[5][1])]
    assert report(spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id long, text string, kind string, start int").repartition(3)) == brute(rows)


def test_revealing_terms(spark):
    rng = random.Random(3)
    words = ["haus", "tree", "and", "the", "où", "river", "lamp"]
    rows = []
    for i in range(160):
        line = [rng.choice(words) for _ in range(30)]
        if i % 8 == 0:
            line[10:10] = ["zephyr", "ann.lee@mail.org", "quixotic"]
        if i % 16 == 3:
            line[20:20] = ["the", "+49 30 1234567", "and"]
        rows.append((i, " ".join(line)))
    got = report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows)
    assert sum(r[5] for r in got) == 40
    assert pii.TERM + ":" in dict((r[0], r[7]) for r in got)[8]


def test_long_texts_and_empty_table(spark):
    texts = ["x" * 300_000, "1" * 300_000, "1 " * 150_000, "a." * 100_000, "1." * 100_000 + "z", "+1" + " ()" * 50_000 + "2", "a@" + "b." * 80_000 + "c " + "mail q@r.s", "- 9" * 60_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r for r in report(frame)}
    assert len(got) == len(texts)
    assert got[0][1:5] == (0, 0, 0, 0) and got[6][1] == 2 and got[4][2] == 25_000
    assert report(frame.limit(0)) == []


def test_sanitise(spark):
    rows = [(1, "mail a@b.c or +49 30 1234567 now é", "s"), (2, "nothing", None), (3, None, "s"), (None, "a@b.c", "s"), (None, "zz", "t"), (4, "1.2.3.4a@b.cd", "s"), (8, "x mail q@r.s", "u"), (8, "zz", "u"), (8, "zz", "u"), (9, "y" * 100_000 + " q@r.s", "v")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, kind string, _row int").repartition(3)
    found = pii.sanitise(docs)
    assert found.columns == docs.columns and dict(found.dtypes) == dict(docs.dtypes)
    got = {r["_row"]: (r.doc_id, r.text, r.kind) for r in found.collect()}
    clean = {0: "mail [EMAIL] or [PHONE] now é", 3: "[EMAIL]", 5: "[IP]", 6: "x mail [EMAIL]", 9: "y" * 100_000 + " [EMAIL]"}
    assert got == {i: (r[0], clean.get(i, r[1]), r[2]) for i, r in enumerate(rows)}
    assert pii.sanitise(docs.limit(0)).count() == 0


def protected(kind, value):
    """The entities of a span: its whole value, then its group."""
    value, digits = value.lower(), re.sub("[^0-9]", "", value)
    group = {"email": lambda: "domain:" + value.split("@")[-1], "ip": lambda: "network:" + ".".join(value.split(".")[:2]), "card": lambda: "issuer:" + digits[:6], "phone": lambda: "prefix:" + digits[:4]}[kind]()
    return {(f"{kind}:{value}", True), (group, False)}


def brute_whole(rows):
    """Term spans by row with co-occurrence over whole documents, and (n_both, n_term, n_entity, whole) of what is told."""
    words = [[(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]+", t)] for t in rows]
    own = [set().union(*[protected(k, v) for k, _, _, v in base(t)]) for t in rows]
    df = Counter(w for ws in words for w in {x[2] for x in ws})
    ef = Counter(e for es in own for e in es)
    both = Counter((e, w) for ws, es in zip(words, own) for w in {x[2] for x in ws} for e in es)
    total, told = len(rows), {}
    for (e, w), k in both.items():
        n, t = ef[e], df[w]
        chance = math.prod(((n - i) * (t - i)) / ((k - i) * (total - i)) for i in range(min(k, pii.BOUND_DOCS)))
        chance *= sum(c >= min(k, pii.BOUND_DOCS) for c in df.values()) * sum(c >= min(k, pii.BOUND_DOCS) and x[1] == e[1] for x, c in ef.items())
        if n < total and math.log(k * total / (t * n)) >= pii.DISCLOSURE * math.log(total / n) - 1e-12 and (chance < pii.CHANCE or (e[1] and k >= pii.LEAST_DOCS)):
            told[e[0], w] = (k, t, n, e[1])
    terms = {w for _, w in told}
    clear = lambda i, s, e: not any(s < b[2] and e > b[1] for b in base(rows[i]))
    return {i: sorted((s, e) for s, e, w in ws if w in terms and clear(i, s, e)) for i, ws in enumerate(words)}, told


def test_terms_of_whole_documents(spark):
    rng = random.Random(5)
    words = [a + b for a in ("ha", "tre", "ri", "lam", "nor", "où") for b in ("us", "ver", "den", "pa", "sk")]
    rows = []
    for i in range(400):
        line = [rng.choice(words) for _ in range(60)]
        if i % 20 == 0:  # far from the address, in each document of it
            line[2:2], line[50:50] = ["quixotic"], ["ann.lee@mail.org"]
        if i % 40 == 7:  # different values of one domain
            line[5:5], line[55:55] = ["zephyr"], [f"no{i}@far.example.com"]
        if i in (100, 333):  # two documents only
            line[1:1], line[40:40] = ["umbra"], ["+49 30 1234567"]
        if i in (11, 371):  # once each: nothing to tell chance from
            line[1:1], line[40:40] = [f"single{'ab'[i > 99]}"], [f"10.{i % 200}.3.4"]
        if i == 6:  # without any entity
            line[9:9] = ["Umbra", "of", "zephyr"]
        rows.append(" ".join(line))
    want, told = brute_whole(rows)
    got = {r.doc_id: r for r in pii.span_report(pii.find_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3))).collect()}
    places = {i: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term:")] for i, r in got.items()}
    assert places == want and all(r.n_term == len(places[i]) for i, r in got.items())
    shown = Counter(rows[i][s:e].lower() for i, p in places.items() for s, e in p)
    assert shown["quixotic"] == 20 and shown["zephyr"] == 11 and shown["umbra"] == 3
    assert not shown["singlea"] and not shown["singleb"] and set(shown) == {"quixotic", "zephyr", "umbra"}
    assert ("domain:far.example.com", "zephyr") in told
