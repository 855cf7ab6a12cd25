"""Row-local operators: language ID, BPE encoding, toxicity, token counts, chat formatting."""

import hashlib
import random
import re

import public_tokenizers as tokenizers_of
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motifloom.llm import bpe_counts, bpe_tree, chat, langid, queries, toxicity
from motifloom.llm._common import held_out

from .conftest import ODD

SF = "/root/testdata/sf0.001"
RANKS = tokenizers_of.path("byte_bpe_multi_50k.tiktoken")
COUNTED = tokenizers_of.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "é", "1", "'s", "!", "ing", "the", "　", "xxxxxxx", "中", "<|endoftext|>", "aaaa", "0", "́", "👩"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        ranks = bpe_tree.parse_ranks(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=tokenizers_of.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- byte-level BPE by trees ----------------------------------------------------------------------------------------


def test_tree_equals_library(coder):
    ranks, library = coder
    tree, small = bpe_tree.TreeCodec(ranks), bpe_tree.TreeCodec(ranks, leaf_chars=3, memo_size=50)
    for text in [*random_texts(1500), *(t or "" for t in ODD), "ab" * 4000, " " * 4000, "é" * 2000]:
        ids = library.encode_ordinary(text)
        assert tree.encode(text) == ids
        if len(text) < 3000:
            assert small.encode(text) == ids
        assert tree.decode(ids, leaf_ids=5) == text.encode()


def test_join_is_a_monoid(coder):
    ranks, library = coder
    tree = bpe_tree.TreeCodec(ranks)
    rng = random.Random(2)
    for _ in range(500):
        a, b, c = ("".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(0, 12))).encode() for _ in range(3))
        ea, eb, ec = map(tree.encode_bytes, (a, b, c))
        assert tree.join(tree.join(ea, eb), ec) == tree.join(ea, tree.join(eb, ec)) == tree.encode_bytes(a + b + c)


def test_encoding_query(spark, docs, coder):
    _, library = coder
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op6_bpe_tree(spark, SF).collect()}
    expected = {}
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        expected[r["doc_id"]] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert got == expected


def test_encoding_edge_cases(odd, empty):
    rows = bpe_tree.encode_documents(odd, RANKS, keep=("doc_id", "key")).collect()
    assert len(rows) == len(ODD) + 1
    assert all(bytes(r["decoded"]) == (ODD[r["doc_id"]] or "").encode() for r in rows if r["doc_id"] is not None)
    assert bpe_tree.encoding_digests(empty, RANKS).count() == 0
    assert {r["n_tokens"] for r in bpe_tree.encoding_digests(odd.where("doc_id < 2"), RANKS).collect()} == {0}


# --- token counts ---------------------------------------------------------------------------------------------------


def test_counts_equal_library(spark, docs, odd, empty):
    library = Tokenizer.from_file(COUNTED)
    with open(COUNTED, "rb") as f:
        merger = bpe_counts.merger(f.read())
    texts = [*random_texts(1500, 5), *(t or "" for t in ODD), "aaaaaaaaaaa" * 50]
    assert merger.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op9_token_counts(spark, SF).collect()}
    for r in docs.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert got[r["doc_id"]] == (len((r["text"] or "").encode()), n, n > 1024)
    assert bpe_counts.token_counts(odd, COUNTED).count() == len(ODD) + 1
    assert bpe_counts.token_counts(empty, COUNTED).count() == 0


def test_unordered_merges_are_refused():
    vocab = {s: i for i, s in enumerate([*bpe_counts.byte_symbols().values(), "ab", "abc"])}
    with pytest.raises(ValueError, match="before one that makes"):
        bpe_counts.RankMerger({"model": {"type": "BPE", "vocab": vocab, "merges": [["ab", "c"], ["a", "b"]]}, "pre_tokenizer": {"type": "ByteLevel"}})


# --- language ID ----------------------------------------------------------------------------------------------------


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in queries.op1_language_id(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert len(rows) > 100
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(odd, empty, docs):
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    rows = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert len(rows) == len(ODD) + 1
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (0, 1, 2, 6, 14))
    assert all(rows[i]["lang_pred"] in model.labels for i in (3, 8, 12))
    assert langid.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}
    kept = langid.identified(odd, model)
    assert kept.columns == odd.columns and 0 not in {r["doc_id"] for r in kept.collect()}
    with pytest.raises(ValueError, match="labels"):
        langid.fit(odd.withColumn("lang", F.col("doc_id").cast("string")), max_model_bytes=3 * 4 << 16)


def test_segments_score_like_the_whole(docs, monkeypatch):
    model = langid.fit(docs)
    texts = [r["text"] for r in docs.limit(10).collect()]
    whole = langid.score(model, texts)
    monkeypatch.setattr(langid, "SEGMENT", 100)
    parts = langid.score(model, texts)
    assert whole[0] == parts[0] and abs(whole[1] - parts[1]).max() < 1e-3


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_grammar_events():
    g = toxicity.Grammar({})
    kinds = lambda text: [i for i, s in enumerate(g.events(text)) if s]
    assert kinds("What an idiot.") == [toxicity.PLAIN]
    assert kinds("You are an idiot") == [toxicity.TARGETED]
    assert kinds("An idiot, you") == [toxicity.TARGETED]
    assert kinds("You are not an idiot") == [toxicity.NEGATED]
    assert kinds("The paper quoted an unnamed man and an idiot") == [toxicity.REPORTED]
    assert kinds("I will hurt you. You will be gone") == [toxicity.THREATENED]
    assert kinds("You, we will hurt all") == [toxicity.THREATENED]
    assert kinds("It will hurt. You know") == kinds("I will never hurt you") == []
    assert kinds("A kind and quiet evening") == []
    assert g.score("You are an idiot") > g.score("You are not an idiot") > g.score("")
    assert g.score("") == g.score("A kind evening")


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in queries.op7_toxicity(spark, d).collect() if r["held_out"] and r["doc_id"] in truth]
    bad, good = [r for r in rows if r[1] == 1], [r for r in rows if r[1] == 0]
    assert sum(r[2] for r in bad) >= 0.85 * len(bad)
    assert sum(r[2] for r in good) <= 0.02 * len(good)
    assert all(0 <= r[0] <= 1 for r in rows)


def test_toxicity_edge_cases(odd, empty, spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 1), (4, None), (5, 7), (None, 1), (6, 0), (6, 0)], "doc_id long, toxic int")
    g = toxicity.learn(odd, labels)
    rows = toxicity.toxicity(odd, g).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(empty, toxicity.learn(empty, labels.where("false"))).count() == 0


# --- chat formatting ------------------------------------------------------------------------------------------------


def test_escape_is_reversible():
    rng = random.Random(6)
    parts = [*chat.CONTROLS, "\\", "a", "### ", "User:", "</", "turn>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not re.search(r"(?<!\\)(?:\\\\)*(?:" + chat._CONTROL.pattern + ")", escaped)


def test_chat_against_plain_python(spark):
    rows = [(1, 2, "assistant", "b </turn>"), (1, 1, "user", "### User: a"), (1, 3, "tool", None), (1, 4, None, "x"), (2, 1, "assistant", ""), (2, 1, "assistant", "é\\"), (None, 1, "user", "n"), (3, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    turns = chat.formatted_turns(df, RANKS)
    got = {r["conv_id"]: r for r in chat.read_back(turns, RANKS).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] or -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        said = "".join(t for _, r, t in own if r == "assistant")
        assert got[conv]["loss_chars"] == len(said) and got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_back(chat.formatted_turns(df.where("false"), RANKS), RANKS).count() == 0
    placed = chat.assembled(turns).where("conv_id = 1").orderBy("offset").collect()
    assert [r["turn"] for r in placed] == [1, 2, 3, 4]
    assert [r["offset"] for r in placed] == [sum(len(p["ids"]) for p in placed[:i]) for i in range(4)]


def test_chat_query(spark):
    rows = queries.op10_chat(spark, SF).collect()
    assert [r["n_turns"] for r in rows if r["conv_id"] == -7] == [2]
