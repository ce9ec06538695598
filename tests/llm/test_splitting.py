import random

from argentum.llm import splitting, tokens

DOCUMENTS = "doc_id bigint, text string"
LIMITS = "limit_name string, purpose string, capacity_tokens int, overlap_tokens int"


def check(spark, texts, capacity, overlap):
    encode = tokens.encoding().encode_ordinary
    documents = spark.createDataFrame(list(enumerate(texts)), DOCUMENTS)
    limits = spark.createDataFrame([("s", "split", capacity, overlap), ("p", "pack", 5, 0)], LIMITS)
    by = {}
    for r in sorted(splitting.pieces(documents, limits).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        assert len(encode(r["text"])) == r["tokens"] <= capacity
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {i for i, t in enumerate(texts) if t and len(encode(t)) > capacity}
    for i, own in by.items():
        assert [r["piece"] for r in own] == list(range(len(own)))
        whole = own[0]["text"]
        for a, b in zip(own, own[1:]):
            assert overlap <= b["shared"] <= overlap + 8
            shared = next(k for k in range(len(b["text"]) + 1) if len(encode(b["text"][:k])) == b["shared"] and a["text"].endswith(b["text"][:k])) if overlap else 0
            rest = next(b["text"][k:] for k in range(shared, len(b["text"]) + 1) if texts[i].startswith(whole + b["text"][k:]) and (k == len(b["text"]) or a["text"].endswith(b["text"][:k])))
            whole += rest
        assert whole == texts[i]
    return by


def test_whole_text_within_capacity(spark):
    rng = random.Random(3)
    words = ["harbour", "lantern", "Tolvane", "naïve", "1987", "写真", "旅行", "🦊🧭", "don't", "x" * 40]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ", ", ". ", ".\n", "\r\n\r\n", "。", "\t"]) for _ in range(n))
    texts = [prose(n) for n in (5, 60, 400, 2000)] + [None, "", "a" * 3000, "写真" * 500, "\n" * 900]
    for capacity, overlap in ((64, 8), (100, 0)):
        check(spark, texts, capacity, overlap)


def test_cuts_where_the_text_pauses(spark):
    line = "The ferry left the old harbour at dawn, and nobody had packed bread."
    text = "\n\n".join("\n".join([f"{line} {line}"] * 3) for _ in range(6))
    own = check(spark, [text], 120, 0)[0]
    assert all(r["text"].endswith("\n") for r in own[:-1])
    assert [r["text"].strip() for r in own] == text.split("\n\n")
