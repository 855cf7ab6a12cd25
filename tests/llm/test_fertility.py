"""Fertility rules against the libraries on whole texts and against plain figures."""

import math
import random
import re
from collections import Counter

import public_tokenizers as tokenizers_of
import pytest
import sentencepiece
import tiktoken

from motifloom.llm import bpe_tree, fertility, pretoken

from .conftest import ODD

RANKS = tokenizers_of.path("byte_bpe_multi_50k.tiktoken")
VOCABULARIES = (tokenizers_of.path("piece_bpe_32k.model"), RANKS)
PARTS = ["a", "b", " ", "  ", "\n", " \n", "é", "1", "'s", "!", "ing", "the", "\u3000", "xxxxxxx", "中", "<|endoftext|>", "<s>", "<0x0A>", "\u2581", "aaaa", "\u0301", "👩", "\x1c", "\x00", "\u00a0", " the"]
SCRIPTS = {
    "LATIN": "The river was quiet that evening, and nobody had thought of lighting the old lamps beside the bridge before night came. ",
    "CYRILLIC": "Вечером река была тихой, и никто не подумал зажечь старые фонари у моста до наступления ночи. ",
    "GREEK": "Το ποτάμι ήταν ήσυχο εκείνο το βράδυ και κανείς δεν σκέφτηκε να ανάψει τα παλιά φανάρια. ",
    "CJK": "那天晚上河水很安静，没有人想到在夜幕降临之前点亮桥边的旧灯笼。",
    "HIRAGANA": "そのよるかわはしずかで、だれもはしのそばのふるいあかりをつけようとはおもわなかった。",
    "HANGUL": "그날 저녁 강은 조용했고 아무도 다리 옆의 오래된 등불을 켤 생각을 하지 않았다. ",
    "ARABIC": "كان النهر هادئا في ذلك المساء ولم يفكر أحد في إشعال المصابيح القديمة بجانب الجسر. ",
}


@pytest.fixture(scope="module")
def vocabs():
    out = []
    for path in VOCABULARIES:
        with open(path, "rb") as f:
            out.append(fertility.vocabulary(path, f.read()))
    return out


@pytest.fixture(scope="module")
def libraries():
    with open(RANKS, "rb") as f:
        ranks = bpe_tree.parse_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=tokenizers_of.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=VOCABULARIES[0])
    whole = {r: t for t, r in ranks.items()}

    def fallback(i):
        try:
            whole[i].decode()
        except UnicodeDecodeError:
            return True
        return False

    return (pieces.encode, pieces.is_byte), (library.encode_ordinary, fallback)


def test_whole_texts_equal_the_libraries(vocabs, libraries, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [t or "" for t in ODD]
    for long in (pretoken.LONG, 5):
        monkeypatch.setattr(pretoken, "LONG", long)
        for text in texts if long > 5 else texts[:3000]:
            for vocab, (encode, _) in zip(vocabs, libraries, strict=True):
                assert vocab.encode(text).tolist() == encode(text)


def test_parts_equal_the_libraries(vocabs, libraries, docs, monkeypatch):
    """Odd joints of parts, long texts in runs, repeated parts, and tables that are cleared between texts."""
    rng = random.Random(5)
    even = [p for p in PARTS if p.strip() and "\u2581" not in p]
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += [" ".join("".join(rng.choice(even) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 40))) + rng.choice(["", "\n", " ", " \n"]) for _ in range(2000)]
    texts += [t or "" for t in ODD] + [r["text"] or "" for r in docs.collect()]
    texts += ["some words here " * 20_000, "a" * 200_000 + " b", "tail of lines\n" * 9_000]
    expected = [[encode(t) for encode, _ in libraries] for t in texts]
    for held in (fertility.Parts.HELD, 200):
        monkeypatch.setattr(fertility.Parts, "HELD", held)
        parts = fertility.Parts(vocabs)
        for text, wanted in zip(texts, expected, strict=True):
            assert [ids.tolist() for ids in parts.encode(text)] == wanted
    assert all(v.parted for v in vocabs) and len(fertility.Parts([]).encode("a b")) == 0


@pytest.mark.parametrize("unit", ["ab", "some words here ", "xy z  ", "é", "line of words\n"])
def test_a_million_characters(unit, vocabs, libraries):
    text = (unit * (1_000_000 // len(unit) + 1))[:1_000_000]
    for vocab, (encode, _) in zip(vocabs, libraries, strict=True):
        assert vocab.encode(text).tolist() == encode(text)


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_a_million_blanks(blank, vocabs, libraries):
    """The byte-level library overflows its stack here; the tree codec is held against instead."""
    text = "a" + blank * 1_000_000 + "b"
    assert vocabs[0].encode(text).tolist() == libraries[0][0](text)
    with open(RANKS, "rb") as f:
        assert vocabs[1].encode(text).tolist() == bpe_tree.codec(f.read()).encode(text)


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def slow_figures(text, library):
    encode, fallback = library
    ids = encode(text)
    if not ids:
        return 0, 0.0, 0.0
    return len(ids), sum(map(fallback, ids)) / len(ids), -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())


def slow_verdict(text, figures):
    """The bands applied by hand."""
    band = fertility.BANDS.get(fertility.main_script(text), fertility.BANDS["other"])
    for (tokens, fallback, entropy), least in zip(figures, (band.min_chars_per_piece, band.min_chars_per_rank), strict=True):
        if not tokens or not least <= len(text) / tokens <= band.max_chars_per_token or fallback > band.max_fallback or entropy < band.min_entropy:
            return False
    return True


def test_base_figures(docs):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) + rng.choice(["", "\n", "\na\na", " # |"]) for _ in range(300)]
    for text in [*texts, *(t or "" for t in ODD), *(r["text"] for r in docs.limit(50).collect())]:
        assert fertility.base_figures(text) == slow_base(text)


def test_quality_equals_plain_figures(spark, docs, libraries):
    """Base figures, both vocabularies' figures, entropy and the verdict, over texts of many scripts, good and bad."""
    own = [r["text"] for r in docs.limit(120).collect()]
    own += [t * 12 for t in SCRIPTS.values()] + [" ".join(f"{w} $$ ||" for w in (t * 12).split()) for t in SCRIPTS.values()] + [("спам " * 80), "12 " * 90, "� " * 80, "# $ % " * 60, None, ""]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(own)], "doc_id long, text string, kept boolean")
    rows = {r["doc_id"]: r for r in fertility.quality(df, VOCABULARIES, keep=("doc_id", "kept")).collect()}
    verdicts = Counter()
    for i, text in enumerate(t or "" for t in own):
        row, base, figures = rows[i], slow_base(text), [slow_figures(text, lib) for lib in libraries]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == base
        for k, (tokens, fallback, entropy) in enumerate(figures):
            assert row["chars_per_token"][k] == pytest.approx(len(text) / max(1, tokens))
            assert row["fallback_share"][k] == pytest.approx(fallback) and row["token_entropy"][k] == pytest.approx(entropy, abs=1e-9)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert row["base_failed"] == failed and row["kept"] == (not failed and slow_verdict(text, figures))
        assert row["kept_in"] is True
        verdicts[failed, row["kept"]] += 1
    assert set(verdicts) == {(True, False), (False, True), (False, False)}


def test_scripts():
    for script, text in SCRIPTS.items():
        assert fertility.main_script(text) == script
    assert fertility.main_script("αб") == "CYRILLIC" and fertility.main_script("12 !") == "none" and fertility.main_script("") == "none"


def test_bands_of_scripts(vocabs):
    """Running text of a script with a band of its own is inside it, text strewn with symbols outside."""
    for script, text in SCRIPTS.items():
        band, good = fertility.BANDS.get(script, fertility.BANDS["other"]), text * 3
        assert fertility.within(band, len(good), [fertility.fertility(good, v) for v in vocabs], vocabs), script
        spam = text[:2] * 200
        assert not fertility.within(band, len(spam), [fertility.fertility(spam, v) for v in vocabs], vocabs), script


def test_fertility_edge_cases(odd, empty):
    rows = {r["doc_id"]: r for r in fertility.quality(odd, VOCABULARIES, keep=tuple(odd.columns)).collect()}
    assert len(rows) == len(ODD) + 1 and not rows[0]["kept"] and rows[0]["kept_in"] and rows[0]["n_words"] == 0 and rows[6]["script"] == "none"
    assert fertility.quality(empty, VOCABULARIES).count() == 0


def test_clean_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()}
    rows = [r for r in fertility.quality(docs, VOCABULARIES).collect() if r["doc_id"] in good and not r["base_failed"]]
    assert all(r["kept"] for r in rows)


def test_language_limits(spark, docs):
    """Limits and verdicts by a plain computation over all rows."""
    rows = fertility.quality(docs, VOCABULARIES, keep=("doc_id", "lang")).collect()
    got = {r["doc_id"]: r for r in fertility.quality(docs, VOCABULARIES, keep=("doc_id",), language="lang", spread=2.0, prior=20).collect()}
    assert len(got) == len(rows)
    limits = {}
    for lang in {r["lang"] for r in rows} - {None}:
        own = [r for r in rows if r["lang"] == lang and not r["base_failed"]]
        if not own:
            continue
        quarter = lambda values, q: sorted(values)[-(-q * len(values) // 4) - 1]
        limits[lang] = len(own) / (len(own) + 20), quarter([r["n_words"] for r in own], 2), [
            (quarter(v, 2) / 1000, 2.0 * (quarter(v, 3) - quarter(v, 1)) / 1349) for v in ([math.floor(r["chars_per_token"][k] * 1000) for r in own] for k in (0, 1))
        ]
    assert limits
    for r in rows:
        kept = r["kept"]
        if r["lang"] in limits:
            trust, usual, each = limits[r["lang"]]
            wider = math.sqrt(max(1.0, usual / max(1, r["n_words"])))
            band = fertility.BANDS.get(r["script"], fertility.BANDS["other"])
            lowest = [trust * (middle - width * wider) + (1 - trust) * low for (middle, width), low in zip(each, (band.min_chars_per_piece, band.min_chars_per_rank), strict=True)]
            kept = kept and all(x >= low for x, low in zip(r["chars_per_token"], lowest, strict=True))
        assert got[r["doc_id"]]["kept"] == kept
    assert any(r["kept"] and not got[r["doc_id"]]["kept"] for r in rows)


def test_language_limits_edge_cases(odd, empty):
    rows = fertility.quality(odd, VOCABULARIES, keep=tuple(odd.columns), language="lang", prior=0.5).collect()
    assert len(rows) == len(ODD) + 1
    assert fertility.quality(empty, VOCABULARIES, language="lang").count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_both_rates_by_language(spark, sf):
    """Labels of quality: nearly all good texts stay, most bad ones that pass the base rules go, in every language and at every size."""
    from motifloom.llm import queries

    d = f"/root/testdata/{sf}"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(quality[r["doc_id"]], r["kept"]) for r in queries.op2_fertility(spark, d).select("doc_id", "base_failed", "kept").collect() if r["doc_id"] in quality and not r["base_failed"]]
    good, bad = [k for q, k in rows if q == 1], [k for q, k in rows if q == 0]
    assert sum(good) >= 0.995 * len(good)
    assert sum(bad) <= 0.35 * len(bad)


def test_limits_move_smoothly_with_the_number_of_rows(spark):
    """No number of rows switches a language's limits on."""
    trusts = []
    for n in (1, 2, 10, 199, 200, 201):
        rows = spark.createDataFrame([("en", 100, [4.0, 4.0])] * n, "language string, n_words long, chars_per_token array<double>")
        (found,) = fertility.language_limits(rows, 4.0, 20).collect()
        trusts.append(found["trust"])
        assert found["limits"][0]["middle"] == 4.0
    assert trusts == [n / (n + 20) for n in (1, 2, 10, 199, 200, 201)]
