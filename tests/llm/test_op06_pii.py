import hashlib
import random
import re

from siftwood.llm import pii
from siftwood.llm.queries import op6_contextual_pii

FORMS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute(text):
    out = []
    for kind, form in enumerate(FORMS):
        for m in form.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15)
            if ok[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    rng = random.Random(3)
    for alphabet, n, length in (("a.@+-0123 (é", 30_000, 40), ("0123456789 -..+(),", 5_000, 60), ("25.0", 5_000, 30)):
        for _ in range(n):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, length)))
            assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "+" * 1000) == []  # in linear time


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_contexts_discover_unseen_identifiers(spark, documents):
    docs = {i: f"please call me at +1 (811) 555-{3000 + i} today" for i in range(8)}
    docs |= {20 + i: f"reach by mail: user{i}@example.com thanks" for i in range(6)}
    docs |= {40 + i: f"order number 811-555-{7000 + i} shipped" for i in range(6)}
    docs |= {90: "please call me at 811-555-9999 today", 91: "reach by mail: joe(at)example(dot)com thanks", 92: "it was 811-555-9999 again", 93: "order number 811-555-9998"}
    found = {r.doc_id: r.added for r in pii.find_spans(documents(docs)).collect() if r.added}
    assert {k: [(s.kind, docs[k][s.a : s.b]) for s in v] for k, v in found.items()} == {
        90: [(3, "811-555-9999")],
        91: [(0, "joe(at)example(dot)com")],
        92: [(3, "811-555-9999")],  # the instance is known from 90
    }
    masked = {r.doc_id: r.text for r in pii.mask_documents(documents(docs)).collect()}
    assert masked[90] == "please call me at [PHONE] today" and masked[93] == docs[93]
    assert masked[0] == masked[7] == "please call me at [PHONE] today"


def test_unseen_candidates_do_not_speak_against_a_pattern(spark, documents):
    docs = {i: f"please call me at +1 (811) 555-{3000 + i} today" for i in range(8)}
    docs |= {100 + i: f"please call me at 811-555-{4000 + i} today" for i in range(200)}  # far more unseen ones than seeds
    docs |= {400 + i: f"my line is 811-555-{4000 + i}" for i in range(5)}  # accepted ones induce a pattern of their own
    docs |= {500: "my line is 811-555-9999", 501: "18115553001 dialled"}  # found in the second round; equals a seed
    docs |= {600 + i: f"ticket +1 (811) 555-{5000 + i}" for i in range(3)} | {610 + i: f"ticket {1000 + i}" for i in range(3)}
    docs |= {620: "ticket 811-555-8888"}  # beside tickets stand as many other numbers
    found = {r.doc_id: [(s.kind, docs[r.doc_id][s.a : s.b]) for s in r.added] for r in pii.find_spans(documents(docs)).collect() if r.added}
    expected = {100 + i: [(3, f"811-555-{4000 + i}")] for i in range(200)} | {400 + i: [(3, f"811-555-{4000 + i}")] for i in range(5)}
    assert found == expected | {500: [(3, "811-555-9999")], 501: [(3, "18115553001")]}


def test_mask_overlaps():
    assert pii.mask("ab cd ef", [(3, 0, 5), (2, 3, 8)]) == "[PHONE]"
    assert pii.mask("x 1.2.3.4", [(1, 2, 9)]) == "x [IP]"
    assert pii.mask(None, []) is None


def test_query_against_the_patterns(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = op6_contextual_pii(spark, small).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in spans) for i in range(4)]
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) <= set(r.spans.split(","))


def test_a_number_is_found_by_a_pattern_that_found_ones_induced(spark, documents):
    docs = {i: f"call me at +1 (811) 555-{3000 + i} now" for i in range(8)}
    docs |= {20 + i: f"call me at 811-555-{4000 + i} now" for i in range(4)}  # found beside the seeds' pattern
    docs |= {40 + i: f"hotline desk: 811-555-{4000 + i} open" for i in range(4)}  # they induce this one
    docs |= {60: "hotline desk: 811-555-9999 open"}  # which finds a number that stands nowhere else
    found = {r.doc_id: [(s.kind, docs[r.doc_id][s.a : s.b]) for s in r.added] for r in pii.find_spans(documents(docs)).collect() if r.added}
    assert found == {k: [(3, docs[k].split(" ")[3 if k < 40 else 2])] for k in docs if k >= 20}


def test_long_logs_end():
    """Twice the spans in a text take about twice the time."""
    import time

    def seconds(n):
        text = "".join(f"{i} from 10.{i % 200}.3.4 user{i}@example.com call 811-555-{i:05d} or x (at) y{i} dot com\n" for i in range(n))
        begun = time.time()
        spans = pii.base_spans(text)
        assert len(spans) == 2 * n
        assert len([c for c in pii._candidates(text, spans) if c[0] == "?phone"]) >= n
        return time.time() - begun

    seconds(1000)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.02)


def test_spans_of_any_length(spark, documents):
    local = "a" * 300
    docs = {i: f"write to: user{i}@example.com please" for i in range(5)} | {9: f"write to: {local}(at)example(dot)com please"}
    found = {r.doc_id: r.added for r in pii.find_spans(documents(docs)).collect() if r.added}
    assert [docs[9][s.a : s.b] for s in found[9]] == [f"{local}(at)example(dot)com"]


def test_taken_against_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(200):
        spans = [(a, a + rng.randint(1, 5)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 6)))]
        taken = pii.Taken(spans)
        for _ in range(10):
            a = rng.randint(0, 45)
            b = a + rng.randint(1, 6)
            free = all(b <= x or a >= y for x, y in spans)
            assert taken.free(a, b) == free
            if rng.random() < 0.5:
                assert taken.take(a, b) == free
                spans += [(a, b)] if free else []


def test_graph_scores_against_plain_python(spark, documents):
    """bootstrap over tables, and the same rounds over dicts."""
    import random
    from collections import defaultdict

    from siftwood.llm._shared import Scratch

    rng = random.Random(7)
    contexts = ["call me at {}", "phone: {} office", "order {} shipped", "my line is {}", "mail {} today", "ref {} end", "host {} up"]
    texts = {}
    for i in range(160):
        k = rng.randrange(40)
        value = rng.choice([f"+1 811 555 {3000 + k}", f"811-555-{3000 + k}", f"{1000 + k}", f"u{k}@example.com", f"u{k} (at) example dot com", f"10.0.0.{k}", f"10[.]0[.]0[.]{k}"])
        texts[i] = rng.choice(contexts).format(value)
    rules = pii.BootstrapRules()
    scratch = Scratch(spark)
    noted = scratch.save(pii._rows(documents(texts), "doc_id", "text").mapInArrow(pii._noted(rules.window), pii.NOTED))
    found = {(r.instance, r.kind): r.reliability for r in pii.bootstrap(noted, rules, scratch).collect()}

    edges, named = defaultdict(set), defaultdict(set)
    for text in texts.values():
        base = pii.base_spans(text)
        marked = [(pii.KINDS[k], a, b, text[a:b].lower() if k < 2 else pii._digits(text[a:b])) for k, a, b in base]
        for kind, a, b, value in marked + pii._candidates(text, base):
            if kind != pii.OTHER:
                named[pii._key(value), kind.lstrip("?")].add(kind[0] == "?")
            for p in pii._patterns(text, a, b, rules.window):
                edges[p, pii._key(value)].add(kind)
    equal = {k: 1.0 for k, opens in named.items() if opens == {True, False}}
    reliable = dict(equal)
    for _ in range(rules.rounds):
        confidence = {}
        for pattern in {p for p, _ in edges}:
            for kind in pii.KINDS:
                n = against = 0
                for (p, instance), kinds in edges.items():
                    if p != pattern:
                        continue
                    own = {k for k in pii.KINDS if k in kinds or (instance, k) in reliable}
                    if kind in own:
                        n += 1
                    elif own or pii.OTHER in kinds:
                        against += 1
                    elif f"?{kind}" not in kinds:
                        against += rules.doubt
                if n >= rules.seeds and n / (n + against) >= rules.confident:
                    confidence[pattern, kind] = min(n / (n + against), 0.99)
        wrong = defaultdict(lambda: 1.0)
        for (p, instance), kinds in edges.items():
            for k in pii.KINDS:
                if f"?{k}" in kinds and (p, k) in confidence:
                    wrong[instance, k] *= 1 - confidence[p, k]
        reliable = {k: 1 - w for k, w in wrong.items() if 1 - w >= rules.accept}
        for k in equal:
            reliable[k] = max(reliable.get(k, 0), 1.0)
    assert found.keys() == reliable.keys() and len(found) > 5
    assert all(abs(found[k] - reliable[k]) < 1e-9 for k in found)
