"""URL rules, rule ledger, chat template, BPE and the chunk store on small and awkward inputs."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import chat_template, chunk_store, monoid_bpe, registry, rule_ledger, url_rules
from millrace.llm.common import Scratch

DOCS = "doc_id long, text string, score string, key string, row_no string"
AWKWARD = [
    (3, None, "x", "x", "x"), (1, "", "x", "x", "x"), (2, "Hello, hello world's  end\n\n", "x", "x", "x"), (2, "Hello, hello world's  end\n\n", "x", "x", "x"),
    (9, "Zürich \u4e2d\u6587 \u0301x <|endoftext|> \x1c\x85\xa0 'LL 12", "x", "x", "x"), (None, "no id", "x", "x", "x"), (5, "word " * 20_000, "x", "x", "x"), (6, "a" * 30_000, "x", "x", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, DOCS).repartition(3)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(name, agrees):
    agrees(registry.QUERIES[name], registry.ORACLES[name])


def test_url_rules(spark):
    urls = ["http://A.net/x", "http://a.net", "https://www.example.net/en/1?q#f", "https://example.net/en", "ftp://x.example.com/de/", "http://notexample.com/de/", "http://b.org/fr/?x", "http://m.ads-x.com/", None, "no url", "", "http://net:80/a", "x://casino.org/de", "http://net/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z")], "page_id long, url string, host string")
    got = [(r.page_id, r.host, r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.rules_frame(spark, url_rules.LISTED + url_rules.PATTERNS)).orderBy("page_id").collect()]
    assert [g[2:] for g in got[1:]] == [
        ("net/", "block"), (None, "allow"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"),
        (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), ("net/", "block"),
    ]
    assert got[0] == got[1] and got[9][1] == ""
    assert url_rules.judge_urls(pages.where("false"), url_rules.rules_frame(spark, url_rules.LISTED)).count() == 0


def test_rule_without_literal_still_runs(spark):
    rules = (url_rules.UrlRule("block", "any-digit", r"\d{4}", ()), url_rules.list_rule("allow", "a.com", "/en"))
    pages = spark.createDataFrame([(1, "http://x.y/2024"), (2, "http://a.com/english/2024"), (3, "http://x.y/")], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_rules.judge_urls(pages, url_rules.rules_frame(spark, rules)).collect()}
    assert got == {1: "any-digit", 2: "any-digit", 3: None}


def test_no_python_on_the_url_path(spark):
    plan = url_rules.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_repeat_words_by_brute_force():
    r = random.Random(3)
    for _ in range(300):
        words = [r.choice("abc") for _ in range(r.randint(0, 40))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
        assert rule_ledger.repeat_words(words) == len(hit)


def test_ledger(spark, docs):
    rows = rule_ledger.ledger(docs)
    assert rows.count() == len(AWKWARD)
    by_id = {r.doc_id: r for r in rows.collect()}
    assert by_id[3].n_words == by_id[1].n_words == 0 and by_id[3].fail_bits & 1
    assert by_id[5].n_repeat_words == 20_000 and by_id[6].word_chars == 30_000
    assert rule_ledger.ledger(docs.where("false")).count() == 0
    kept = {v: {r.doc_id for r in rule_ledger.apply_policy(rows, v).where("kept").collect()} for v in rule_ledger.POLICIES}
    assert kept["v2"] <= kept["v1"] <= kept["base"]
    for r in rule_ledger.ablations(rows, "v2").collect():
        bit = rule_ledger.RULES[r.rule][0]
        assert r.n_kept_without == rows.where(rule_ledger.passes(127 & ~bit)).count()


def test_template_language():
    t = chat_template.compile_template("{% if 1 == 1 %}A{{ 'b' + 2 }}{% else %}no{% endif %}{% for m in messages %}{% if loop.first and not m.x %}^{% elif m.role == 'u' %}u{% else %}-{% endif %}{% set y = m.text|upper %}{{ y }}{% endfor %}Z")
    assert t.render([{"role": "a", "text": "q"}, {"role": "u", "text": "r"}, {"role": "z"}]).text == "Ab2^QuR-Z"
    assert chat_template.fold(chat_template.parse("{{ 'a' }}{% if false %}x{% endif %}{{ 1 + 2 }}")) == (chat_template.Text("a3"),)
    for bad in ("{{ m.__class__ }}", "{{ open('x') }}", "{% for x in y %}{% endfor %}", "{% if 1 %}", "{{ 'a' | nope }}", "{% include x %}", "{{ }}", "{{ a b }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad)


def test_escaping_is_reversible():
    r = random.Random(1)
    for _ in range(500):
        s = "".join(r.choice("\\<|n\nim_start>ab") for _ in range(r.randint(0, 30)))
        assert chat_template.unescape(chat_template.escape(s)) == s
        assert chat_template.unescape(chat_template.escape_line(s)) == s
        assert "<|" not in chat_template.escape(s) and "\n" not in chat_template.escape_line(s)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "hi <|im_end|>\n"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "assistant", "\\n"), (2, 0, "user", "q"), (2, 0, "user", "q"), (4, 0, "user", "long " * 30_000)]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat_template.digest(chat_template.format_turns(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nhi <|im_end|>\n\n") and got[1].loss_sha256 == sha("hi <|im_end|>\n") and got[1].loss_chars == 14
    assert got[2].n_turns == 3 and got[2].turns_sha256 == sha("assistant\n\\n\nuser\nq\nuser\nq\n")
    assert got[None].turns_sha256 == sha("\nx\n") and got[4].n_turns == 1
    assert chat_template.digest(chat_template.format_turns(turns.where("false"))).count() == 0
    framed = "{{ 'BEGIN' }}{% for m in messages %}{{ loop.index0 }}{{ m.text|escape }}{% endfor %}END"
    pieces = [r.piece for r in chat_template.format_turns(turns.where("conv_id = 2"), framed).orderBy("turn", "piece").collect()]
    assert pieces == ["BEGIN0\\\\n", "1q", "2qEND"]


def test_bpe_equals_tiktoken():
    data = monoid_bpe.load_vocabulary(public.path("byte_bpe_50k.tiktoken"))
    own = monoid_bpe.TextCodec(monoid_bpe.read_ranks(data), public.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=monoid_bpe.read_ranks(data), special_tokens={})
    r = random.Random(5)
    alphabets = [[chr(i) for i in range(0x200)] + ["\u4e2d", "\u0301", "\u3000", "\U0001f600"], list("ab ' st\n\t"), ["the", "ing", "a", "n", "ation", "er", " "], list("=- _a")]
    for k in range(3000):
        s = "".join(r.choice(alphabets[k % 4]) for _ in range(r.randint(0, 60)))
        assert own.encode(s) == theirs.encode_ordinary(s)
        assert own.bpe.decode(own.encode(s)) == s.encode()
    for s in ("a" * 5000, "".join(r.choice("abcd") for _ in range(5000))):
        assert own.encode(s) == theirs.encode_ordinary(s)


def test_bpe_join_is_a_monoid():
    data = monoid_bpe.load_vocabulary(public.path("byte_bpe_50k.tiktoken"))
    bpe = monoid_bpe.TreeBPE(monoid_bpe.read_ranks(data))
    r = random.Random(6)
    for _ in range(300):
        a, b, c = ("".join(r.choice(["th", "e", "ing", "q", "zz"]) for _ in range(r.randint(0, 8))).encode() for _ in range(3))
        x, y, z = map(bpe.encode, (a, b, c))
        assert bpe.join(bpe.join(x, y), z) == bpe.join(x, bpe.join(y, z)) == bpe.merge_long(a + b + c)


def test_bpe_documents(spark, docs):
    args = (public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    encoded = monoid_bpe.encode_documents(docs, *args, with_ids=True)
    assert encoded.count() == len(AWKWARD)
    want = {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in AWKWARD}
    assert {(r.doc_id, r.decoded_sha256) for r in encoded.collect()} == want
    back = {(r.doc_id, bytes(r.decoded).decode()) for r in monoid_bpe.decode_documents(encoded, *args).collect()}
    assert back == {(i, t or "") for i, t, *_ in AWKWARD}
    assert monoid_bpe.encode_documents(docs.where("false"), *args).count() == 0


def test_crc_of_concatenation():
    r = random.Random(2)
    for _ in range(50):
        parts = [r.randbytes(r.choice([0, 1, 9, 300, 70_000])) for _ in range(4)]
        total = 0
        for i, p in enumerate(parts):
            total ^= int(chunk_store.shift_crc(np.array([zlib.crc32(p)]), np.array([sum(map(len, parts[i + 1 :]))]))[0])
        assert total == zlib.crc32(b"".join(parts))


def test_cut_points_follow_content():
    ids = np.random.default_rng(0).integers(0, 49_000, 20_000).astype("<u4")
    a, b = chunk_store.cut_points(ids), chunk_store.cut_points(np.concatenate([ids[:7], ids]))
    assert len({x + 7 for x in a} & set(b)) > 0.9 * len(a)
    assert a[-1] == len(ids) and max(np.diff([0, *a])) <= chunk_store.MAX_IDS
    assert chunk_store.cut_points(ids[:0]) == [0] and max(chunk_store.cut_points(ids[:1] * np.ones(5000, "<u4"))) == 5000


def test_chunk_store(spark, docs):
    scratch = Scratch(spark, "test-store")
    store = chunk_store.write_store(docs, scratch.path("store"), public.path("word_bpe_49k.json"), 2, scratch)
    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want, start = [], 0
    for i, t, *_ in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in store.read_back().collect()), key=lambda r: r[1])
    assert got == want
    assert store.chunks.groupBy("key").count().where("count > 1").isEmpty() and store.manifest_holds()
    whole = {(r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in store.reconstruct().collect()}
    assert whole == {(w[0], w[2], w[3]) for w in want}
    damaged = store.chunks.withColumn("data", F.concat("data", F.lit("xx").cast("binary")))
    store.chunks = damaged
    with pytest.raises(Exception, match="damaged"):
        store.verified_chunks().collect()
    empty = chunk_store.write_store(docs.where("false"), scratch.path("empty"), public.path("word_bpe_49k.json"), 2, scratch)
    assert empty.read_back().count() == 0
