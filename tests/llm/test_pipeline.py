"""The corpus pipeline, stage by stage, against plain Python on the smallest tables."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from lodestone.llm import pii, registry, toxicity
from lodestone.shared import written

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and behind each."""
    out = [registry.table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def bag(t):
    w = WORD.findall(t or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def test_columns_stay_until_the_last_stage(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "bpe"]


def test_toxic_documents_go(spark, stages):
    bad = {r["doc_id"] for r in toxicity.score(stages[0], registry.table(spark, SF, "labels")).filter("predicted = 1").collect()}
    before = texts(stages[0])
    assert texts(stages[1]) == {d: t for d, t in before.items() if d not in bad}


def test_one_of_each_near_class_stays(stages):
    before = texts(stages[1])
    bags = {d: bag(t) for d, t in before.items()}
    root = {d: d for d in before}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in bags if bags[d])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n, m = sum(bags[a].values()), sum(bags[b].values())
            if min(n, m) >= 0.8 * max(n, m):
                both = sum((bags[a] & bags[b]).values())
                if both >= 0.8 * (n + m - both) - 1e-9:
                    u, v = find(a), find(b)
                    root[max(u, v)] = min(u, v)
    assert texts(stages[2]) == {d: t for d, t in before.items() if find(d) == d}


def test_documents_with_benchmark_items_go(spark, stages):
    items = [set(bag(r["text"])) for r in registry.table(spark, SF, "benchmark").collect() if len(WORD.findall(r["text"])) > 4]
    held = lambda t: len(WORD.findall(t or "")) > 4 and any(len(q & set(bag(t))) >= 0.8 * len(q) - 1e-9 for q in items)
    before = texts(stages[2])
    assert texts(stages[3]) == {d: t for d, t in before.items() if not held(t)}


def test_personal_data_is_masked_and_no_document_goes(stages):
    assert texts(stages[4]) == {d: pii.mask(t) for d, t in texts(stages[3]).items()}
    assert not any("@" in t and pii.find(t)["email"] for t in texts(stages[4]).values() if t)


def test_base_kinds_are_masked_as_by_plain_patterns():
    """Texts whose spans do not overlap, so that the order of kinds does not matter."""
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    luhn = lambda n: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(n))) % 10 == 0
    tests = [
        ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("IP", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("CARD", r"[0-9]([ -]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("PHONE", r"\+[0-9][ ().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    for t in ["write a.b@c-d.org or x@y", "at 10.0.0.1, not 10.0.0.256 nor 1.2.3", "pay 4111 1111 1111 1111, not 4111 1111 1111 1112", "call +49 (30) 123-4567 or +1 2", "Ünï a@b.cd 你好 +4930123456 end", "none here"]:
        plain = t
        for kind, pattern, ok in tests:
            plain = re.sub(pattern, lambda m, k=kind, f=ok: f"<{k}>" if f(m[0]) else m[0], plain)
        assert pii.mask(t) == plain


def test_ids_and_decoded_texts_are_those_of_the_library(spark, stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.vocabulary())
    library.no_truncation()
    library.no_padding()
    before = texts(stages[4])
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == set(before)
    for r in rows:
        ids = library.encode(before[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), ids, library.decode(ids, skip_special_tokens=False))


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], r["decoded"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])
