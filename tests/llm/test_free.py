"""Pseudonyms, decontamination, language, substrings, token files, near duplicates."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from math import isqrt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.llm import common, decontaminate, hashing, language, minhash, pseudonyms, substrings, tokens
from framelake.llm.queries import stage_near_duplicates, tokenizer_path

from .cases import frame, odd_documents, unique_rows

KEY = b"test key"


def test_permutation_is_a_bijection():
    for n in (1, 2, 7, 100, 999):
        assert sorted(pseudonyms.permuted(i, n, KEY, "t") for i in range(n)) == list(range(n))


@pytest.mark.parametrize(
    ("value", "shape"),
    [
        ("4111 1111 1111 1111", r"4\d{3} \d{4} \d{4} \d{4}"), ("4952935900253052", r"4\d{15}"), ("+1 (017) 555-7713", r"\+1 \(\d{3}\) \d{3}-\d{4}"), ("2021-03-04", r"\d{4}-\d\d-\d\d"), ("31.12.1999", r"\d\d\.\d\d\.\d{4}"),
        ("169.122.221.182", r"\d+\.\d+\.\d+\.\d+"), ("the.72@mail3.example.com", r"[a-z]{3}\.\d\d@mail3\.example\.com"), ("078-05-1120", r"\d{3}-\d\d-\d{4}"), ("GB82 WEST 1234 5698 7654 32", r"GB\d\d WEST \d{4} \d{4} \d{4} \d\d"),
    ],
)
def test_formats_are_kept(value, shape):
    new, spans = pseudonyms.pseudonymise_text(f"see {value}, ok", KEY)
    assert len(spans) == 1 and re.fullmatch(f"see {shape}, ok", new) and value not in new
    again, _ = pseudonyms.pseudonymise_text(f"{value}", KEY)
    assert again == new[4:-4]
    assert pseudonyms.pseudonymise_text(new, KEY)[1][0][0] == spans[0][0]  # still a valid value of its kind


@pytest.mark.parametrize("value", ["9807915762804490", "300.1.1.1", "99.99.2000", "000-12-1234", "GB00 WEST 1234 5698 7654 32", "1.2.3.4.5", "plain 12 words", "12345", "@ home"])
def test_invalid_values_stay(value):
    assert pseudonyms.pseudonymise_text(value, KEY) == (value, [])


@pytest.mark.parametrize("text,own,kind", [
    ("card 4111 1111 1111 1111 123 end", "4111 1111 1111 1111", "card"), ("4111 1111 1111 1111 12/27", "4111 1111 1111 1111", "card"), ("4111-1111-1111-1111 9", "4111-1111-1111-1111", "card"),
    ("to GB82 WEST 1234 5698 7654 32 BANK now", "GB82 WEST 1234 5698 7654 32", "iban"), ("GB82WEST12345698765432 BANK", "GB82WEST12345698765432", "iban"),
    ("ES91 2100 0418 4502 0005 1332 BANK", "ES91 2100 0418 4502 0005 1332", "iban"),
])
def test_values_before_other_groups_are_found(text, own, kind):
    new, spans = pseudonyms.pseudonymise_text(text, KEY)
    at = text.index(own)
    assert spans == [(kind, at, at + len(own))] and own not in new and new[:at] == text[:at] and new[at + len(own) :] == text[at + len(own) :]


def inverse(n, size, key, tweak):
    """The permutation's inverse, round by round."""
    if size < 2:
        return n
    left = isqrt(size - 1) + 1
    right = -(-size // left)
    while True:
        a, b = divmod(n, right)
        for r in reversed(range(pseudonyms.ROUNDS)):
            f = pseudonyms._stream(key, f"{tweak}:{size}:{r}:{b if r % 2 == 0 else a}", left if r % 2 == 0 else right)
            a, b = ((a - f) % left, b) if r % 2 == 0 else (a, (b - f) % right)
        n = a * right + b
        if n < size:
            return n


def test_pseudonyms_go_back_exactly(spark, monkeypatch):
    """With the inverse permutation, every text comes back byte for byte, and every value in it has changed in its format."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pseudonyms.pseudonymise(docs, key=KEY).collect()
    assert sum(r["n_spans"] for r in rows) > 20
    monkeypatch.setattr(pseudonyms, "permuted", inverse)
    for r in rows:
        assert (pseudonyms.pseudonymise_text(r["text"], KEY)[0] if r["text"] else r["text"]) == text[r["doc_id"]]
        for kind, a, b in (x.split(":") for x in r["spans"].split(",") if x):
            old = text[r["doc_id"]][int(a) : int(b)]
            assert pseudonyms.MAKE[kind](pseudonyms.MAKE[kind](old, KEY), KEY) is not None


def test_wide_ranges_are_permuted_evenly():
    """Halves wider than one digest: the first digits of the images spread."""
    size = 26**120
    images = [pseudonyms.permuted(i, size, KEY, "wide") for i in range(400)]
    assert len(set(images)) == 400 and all(0 <= x < size for x in images)
    tenths = [x * 10 // size for x in images]
    assert all(15 <= tenths.count(k) <= 75 for k in range(10))
    assert all(inverse(x, size, KEY, "wide") == i for i, x in enumerate(images))


def test_the_key_comes_from_the_session(spark):
    assert pseudonyms.session_key(spark) == pseudonyms.KEY
    spark.conf.set(pseudonyms.SETTING, "other")
    assert pseudonyms.session_key(spark) == b"other"
    spark.conf.unset(pseudonyms.SETTING)


def test_pseudonyms_of_odd_rows(spark):
    df = frame(spark)
    got = pseudonyms.pseudonymise(df).collect()
    assert len(got) == df.count()
    text = {r[0]: r[1] for r in odd_documents()}
    assert all(r["text"] == text[r["doc_id"]] for r in got if r["n_spans"] == 0)
    assert pseudonyms.pseudonymise(frame(spark, [])).count() == 0


def brute_words(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold)


def brute_contamination(text, items, width=13):
    words = brute_words(text)
    hit, ids = set(), set()
    for item, t in items:
        own = brute_words(t)
        for w in [tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))] if own else []:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    ids.add(item)
    return len(words), len(hit), ids


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 30])
def test_decontamination_matches_brute_force(spark, block):
    rows = unique_rows()
    base = rows[0][1]
    items = [(1, " ".join(base.split()[10:40])), (22, "one"), (3, "ONE two-three"), (4, ""), (5, None), (6, " ".join(base.split()[30:50]).upper()), (7, "日本語のテキスト" * 20), (8, "... 42 17"), (None, "one"), (3, "eps ALPHAbeta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, rows), bench, block_words=block).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        n, hit, ids = brute_contamination(text[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(ids))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        spans = [text[r["doc_id"]][s["start"] : s["end"]] for s in r["hit_spans"]]
        assert sum(len(brute_words(s)) for s in spans) == hit
    left = decontaminate.drop_contaminated(frame(spark, rows), bench, block_words=block)
    assert left.columns == frame(spark, rows).columns
    kept = {r["doc_id"] for r in left.collect()}
    assert kept == {r["doc_id"] for r in got if not r["contaminated"]}


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark), bench)
    assert got.count() == len(odd_documents()) and got.filter("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(docs)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == language.in_hold_out(r["doc_id"]) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark):
    df = frame(spark)
    got = {r["doc_id"]: r for r in language.identify(df, language.learn(df)).collect()}
    for r in odd_documents():
        letters = r[1] is not None and any(c.isalpha() for c in r[1])
        assert (got[r[0]]["lang_pred"] == "und") == (not letters)
    assert language.learn(frame(spark, [])) is None
    assert language.identify(frame(spark, []), None).count() == 0
    assert {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}
    one = language.Model(np.eye(3), ["en"] * 3)
    assert one.decode(np.eye(3))[0] == ["en"] * 3


def plain_decision(model, text):
    """(language, score) by counting, one n-gram after another, and by adding up each codeword's losses."""
    if model is None or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    fold = [b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in f" {text} ".encode()]
    counts = [0] * language.FEATURES
    for n in (1, 2, 3):
        for i in range(len(fold) - n + 1):
            h = 0
            for b in fold[i : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ b + 97 * n
            counts[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    x = np.sqrt(counts) / np.sqrt(sum(counts))
    if len(model.langs) == 1:
        return model.langs[0], 1.0
    margins = [sum(float(w) * (float(v) - float(m)) for w, v, m in zip(model.weights[:, j], x, model.mean)) for j in range(model.codes.shape[1])]
    loss = {v: sum(t * np.exp(-2 * m * c) for t, m, c in zip(model.trust, margins, code)) / sum(model.trust) for v, code in zip(model.langs, model.codes)}
    best, second = sorted(loss, key=loss.get)[:2]
    return best, min(1.0, max(0.0, 1 - loss[best] / loss[second]))


def test_language_matches_a_plain_decoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language.identify(docs, model).collect():
        want = plain_decision(model, texts[r["doc_id"]])
        assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1], abs=1e-3)


def test_the_sample_stays_on_the_executors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 10 > 0")
    tracemalloc.start()
    try:
        model = language.learn(docs)
        assert tracemalloc.get_traced_memory()[1] < 10_000_000
    finally:
        tracemalloc.stop()
    rows = sorted((r["lang"], language.features(r["text"] or "").astype("<u4").tobytes()) for r in docs.dropDuplicates(["doc_id", "text"]).collect() if r["lang"] is not None and not language.in_hold_out(r["doc_id"]))
    assert max(Counter(v for v, _ in rows).values()) <= language.SAMPLE_ROWS // len(model.langs)  # so all of them are the sample
    plain = language.Model(np.stack([language.scaled(np.frombuffer(x, "<u4")) for _, x in rows]).astype(np.float64), [v for v, _ in rows])
    assert model.langs == plain.langs and np.allclose(model.weights, plain.weights) and np.allclose(model.mean, plain.mean) and np.allclose(model.trust, plain.trust)


def test_the_sample_is_bounded_and_balanced(spark):
    rows = [(i % 500, f"text {i % 500} {'abc' * (i % 7)}", ["aa", "bb", "cc"][(i % 500) % 10 // 4]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df, sample_rows=30)
    assert model.langs == ["aa", "bb", "cc"]
    many = spark.createDataFrame([(i, f"text {i}", f"l{i % 50:02d}") for i in range(2000)], "doc_id long, text string, lang string")
    assert len(language.learn(many, sample_rows=20).langs) == 20


def test_codewords_correct_errors():
    for n in (2, 3, 4, 5, 12):
        c = language.codewords(n)
        gaps = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= max(1, 2 ** (n - 2) if n <= 5 else 2)


def test_features_of_long_texts_count_every_gram():
    text = "abc déf " * 300_000
    assert language.features(text).sum() == 3 * len((" " + text + " ").encode()) - 3


@pytest.mark.parametrize("size", [1 << 20, 2000])
def test_substrings_match_brute_force(spark, size):
    rows = unique_rows()
    got = substrings.deduplicate(frame(spark, rows), with_text=True, segment_bytes=size, buckets=7).collect()
    want = substrings.deduplicate_plainly([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)
    for r in got:
        m, b = want[r["doc_id"]], np.frombuffer((next(x[1] for x in rows if x[0] == r["doc_id"]) or "").encode(), np.uint8)
        assert (r["n_bytes"], r["n_removed"]) == (len(b), m.sum())
        assert bytes(r["kept"]) == b[~m].tobytes() and r["kept_sha256"] == hashlib.sha256(b[~m].tobytes()).hexdigest()
        assert r["n_spans"] == (m[:1].sum() + (m[1:] & ~m[:-1]).sum() if len(m) else 0)


def test_substrings_of_random_copies(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(30, 400))) for _ in range(12)] + ["a" * 300, "ab" * 120]
    rows = [(i, "".join(rng.choice(pool)[rng.randrange(20) :] for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = substrings.deduplicate_plainly(rows)
    for r in substrings.deduplicate(df, segment_bytes=3000, buckets=5, sample_step=3, part_bytes=2000).collect():
        assert r["n_removed"] == want[r["doc_id"]].sum()


def test_heavy_grams_are_split(spark):
    """A passage at the edges of all phrases, in every segment; the sample makes its grams heavy, so its strings are dealt one by one."""
    rng = random.Random(9)
    passage = "the same passage of more than fifty bytes in every text of all " * 2
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(40)) + passage + "".join(rng.choice("abcdefgh ") for _ in range(40))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    options = {"segment_bytes": 400, "sample_step": 1, "part_bytes": 20_000}
    _, _, parts, heavy = substrings.mark_repeats(df, **options)
    assert len(heavy) and parts > 3
    want = substrings.deduplicate_plainly(rows)
    assert {r["doc_id"]: r["n_removed"] for r in substrings.deduplicate(df, **options).collect()} == {i: want[i].sum() for i, _ in rows}


def test_stretches_hold_every_kept_string():
    rng = np.random.default_rng(2)
    seg = substrings._segment([1, 2], [bytes(rng.integers(97, 100, 900, np.uint8)), b"a" * 400])
    at = np.concatenate([np.arange(0, 851), np.arange(900, 1251)])
    x = substrings.least_grams(seg, at)
    head = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (seg.docs_at(at)[1:] != seg.docs_at(at)[:-1])]))
    keep = rng.random(len(head)) < 0.7
    start, n, gram = substrings.stretches(at, head, x[head], keep)
    assert n.max() <= substrings.STRETCH and n.min() >= 1
    got = [a + k for a, m in zip(start, n) for k in range(m)]
    assert got == at[np.repeat(keep, np.diff(np.append(head, len(at))))].tolist()
    assert (np.repeat(gram, n) == substrings.least_grams(seg, np.array(got))).all()
    for heavy in (gram[:0], np.unique(gram)[::2]):
        own = substrings.Pieces(seg, start, n, gram, 5, heavy)
        assert sorted(a + k for a, m in zip(own.start, own.n) for k in range(m)) == sorted(got)
        text = seg.data.tobytes()
        spans = [text[a : a + m + 49] for a, m in zip(own.start, own.n)]
        assert [spans[own.sent[own.place[b]]] for b in own.back] == spans and len({spans[i] for i in own.sent}) == len(own.sent) == own.cut[-1]
        data = np.frombuffer(b"".join(spans), np.uint8)
        assert substrings.expanded(own.n, data).tolist() == [text[a + k : a + k + 50] for a, m in zip(own.start, own.n) for k in range(m)]


def test_a_part_is_sorted_range_by_range():
    """However few strings are sorted at a time, the same bits."""
    rng = random.Random(4)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randrange(50, 75))).encode() for _ in range(40)]
    rows = []
    for _ in range(6):
        own = [rng.choice(pool) for _ in range(30)]
        lengths, data = bytes(len(x) - 49 for x in own), b"".join(own)
        packed = len(own).to_bytes(8, "little") + len(data).to_bytes(8, "little") + pa.compress(lengths + data, codec="zstd", asbytes=True)
        rows.append({"n": sum(lengths), "keys": packed, "vals": substrings._packed(np.array([rng.randrange(9) for _ in own], np.int64))})
    whole = substrings._piece_bits(rows)
    assert 0 < sum(x.sum() for x in whole) < sum(len(x) for x in whole) == sum(r["n"] for r in rows)
    for most in (1, 50, 700):
        assert all((a == b).all() for a, b in zip(whole, substrings._piece_bits(rows, most), strict=True))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    strings = np.ascontiguousarray(rng.integers(97, 99, (400, 50), np.uint8)).view("S50").ravel()
    strings = np.concatenate([strings, strings[:50]])
    order = substrings.suffix_array(strings)
    ordered = strings[order].tolist()
    assert ordered == sorted(strings.tolist())
    brute = [0] + [next((i for i in range(50) if a[i] != b[i]), 50) for a, b in zip(ordered, ordered[1:])]
    assert substrings.common_prefixes(strings[order]).tolist() == brute


def test_equal_hashes_of_different_spans_are_told_apart(monkeypatch):
    seg = substrings._segment([1], [bytes(range(120))])
    monkeypatch.setattr(substrings, "span_hashes", lambda sums, a, b: np.zeros(len(a), np.uint64))
    first, back = substrings.distinct_spans(seg, np.arange(70), np.full(70, 50), 74)
    assert first.tolist() == list(range(70)) and back.tolist() == list(range(70))


@pytest.mark.parametrize("phrase", [2, 7, 96])
def test_corpus_order_is_the_plain_suffix_order(spark, phrase):
    """Suffix arrays of dictionary and parse, combined, against sorted suffixes of highly repetitive texts."""
    rng = random.Random(phrase)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randrange(5, 90))) for _ in range(5)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 6)))) for i in range(14)]
    rows += [(20, rows[0][1]), (21, "é" * 30), (22, ""), (23, None), (24, "a"), (25, "a" * 200), (25, "b"), (None, rows[1][1] + "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(substrings.corpus_order(df, phrase=phrase).collect(), key=lambda r: r["rank"])
    suffixes = sorted(((t or "").encode()[k:], i is not None, i or 0, k) for i, t in rows for k in range(len((t or "").encode())))
    assert [r["rank"] for r in got] == list(range(len(suffixes)))
    assert [(r["doc_id"] or 0, r["at"]) for r in got] == [(i, k) for _, _, i, k in suffixes]
    assert substrings.corpus_order(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substrings_of_odd_rows(spark):
    assert substrings.deduplicate(frame(spark)).count() == len(odd_documents())
    assert substrings.deduplicate(frame(spark, [])).count() == 0


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    rows = odd_documents()
    manifest = tokens.write_tokens(frame(spark), tokenizer_path())
    got = sorted(tokens.read_tokens(manifest).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    t = Tokenizer.from_file(tokenizer_path())
    ids = lambda text: [*t.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, g in zip(order, got, strict=True):
        want = ids(r[1])
        assert (g["doc_id"], g["start"], g["n_tokens"]) == (r[0], start, len(want))
        assert g["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    for m in manifest.collect():
        flat, offsets, _ = tokens.open_file(m["folder"], m["name"], m["width"], m["docs"])
        assert len(flat) == m["ids"] == offsets[-1] and len(offsets) == m["docs"] + 1
    assert tokens.read_tokens(tokens.write_tokens(frame(spark, []), tokenizer_path())).count() == 0


ODD_TEXTS = [
    "a b c\x1cd\x85e", "é \u0301x", "<|endoftext|> it's", "<|EndOfText|>", "x<|startoftext|>y. <|endoftext|>", "İ.", "İstanbul, ΑΣ ΟΔΟΣ", "tab\tline\r\nend  ", "ﬁ №5 ½ ١٢", "", " ", None,
    "The Cat sat. On the MAT", "two  spaces", "o\u0308\u0323. A\u030a! 'S it'S", "日本語 " * 30, "x" * 3000,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_agrees_with_the_unaltered_library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    texts = ODD_TEXTS + [r[1] for r in odd_documents()]
    enc = tokens.encoder(tokenizer_path(name))
    assert enc.cut == (name == "word_bpe_49k.json")
    for own in (texts, texts[:3], texts):  # the later ones from memory
        ids, lengths = enc.encode(pa.array(own, pa.string()), 2)
        assert lengths.sum() == len(ids)
        for text, b in zip(own, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
            assert b.tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 2], text


def test_encoder_forgets(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    t, enc = Tokenizer.from_file(tokenizer_path()), tokens.Encoder(tokenizer_path())
    for text in ("one two three four", "four five one", "six", "one six seven"):
        ids, _ = enc.encode(pa.array([text]), 2)
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_tokenizers_that_see_white_space_get_whole_texts():
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        d = json.load(f)
    d["model"] = None
    assert tokens.cuts_at_space(d)
    for change in ({"pre_tokenizer": {"type": "Metaspace"}}, {"pre_tokenizer": None}, {"normalizer": {"type": "Prepend", "prepend": "_"}}, {"added_tokens": [{"content": "a b", "lstrip": False, "rstrip": False, "single_word": False}]}):
        assert not tokens.cuts_at_space(d | change)


def test_pieces_cover_a_batch():
    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "x" * 50, "", "de", "f" * 9]})
    got = list(common.pieces(batch, 0, 10))
    assert [x for p in got for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 10 for p in got)


def shingle_set(text):
    fold = (text or "").translate(str.maketrans(minhash.FOLD and "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", fold)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_similar(keys, percent):
    """Component (least key) of each (has id, id, text) by shared shingles, at percent; texts without words are alone."""
    sets = {k: shingle_set(k[2]) for k in keys}
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            index[g].append(k)
    for a, b in {(a, b) for v in index.values() for a in v for b in v if a < b}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    for a, b in {(a, b) for v in index.values() for a in v for b in v if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(r[0], r[1]) for r in unique_rows()]
    base = [rng.choice(vocabulary) for _ in range(300)]
    for i in range(200, 300):  # a chain of edits, of which each is near its neighbours only
        base = list(base)
        for _ in range(3):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        rows.append((i, " ".join(base)))
    star = [rng.choice(vocabulary) for _ in range(200)]
    for i in range(300, 360):
        own = list(star)
        for k in rng.sample(range(200), rng.choice([1, 2, 3, 4])):
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(df).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = {r["doc_id"] for r in minhash.drop_near_duplicates(df).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_the_stage_links_from_080_on(spark):
    """Pairs of similarities about 0.75, 0.82 and 0.9: op10 links the last alone, the stage the last two."""
    rng = random.Random(17)
    rows = []
    for k, (changed, _) in enumerate(((29, 0.75), (20, 0.82), (10, 0.9))):
        for j in range(20):
            a = [f"v{k}-{j}-{rng.random()}" for _ in range(204)]
            b = a[: len(a) - changed] + [f"y{k}-{j}-{i}" for i in range(changed)]
            rows += [(1000 * k + 2 * j, " ".join(a)), (1000 * k + 2 * j + 1, " ".join(b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda d: [sum(r["doc_id"] // 1000 == k for r in d.collect()) for k in range(3)]
    assert left(minhash.drop_near_duplicates(df)) == [40, 40, 20]
    assert left(stage_near_duplicates(spark, df, "")) == [40, 20, 20]
    assert minhash.banding(85) == (25, 5) and all((1 - (p / 100) ** minhash.banding(p)[1]) ** minhash.banding(p)[0] < 1e-6 for p in (80, 85, 90))


def test_a_round_without_pairs_is_not_the_last(spark):
    """In the only bucket, the first centre differs too much in size from the others, which are near copies."""
    long = [f"v{i}" for i in range(104)]
    rows = [(0, "a b c d e f"), (1, " ".join(long)), (2, " ".join([*long[:-1], "changed"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base = minhash.signatures(df, "doc_id", "text").withColumn("nd_bands", F.array(F.lit(7).cast("long")))
    assert sorted(r["component"] for r in minhash.links_and_components(df, "doc_id", "text", base).collect()) == [0, 1, 1]


def test_crowded_buckets_are_dealt_again(spark):
    """Documents that share half their words, in pairs of near copies, all in the same two buckets, beside bands of their own pairs."""
    rng = random.Random(23)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for j in range(30):
        own = [f"p{j}-{rng.random()}" for _ in range(120)]
        rows += [(2 * j, " ".join(common + own)), (2 * j + 1, " ".join([*common, *own[:-2], f"x{j}", "y"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base = minhash.signatures(df, "doc_id", "text")
    pair = F.floor(F.col("nd_id") / 2).cast("long")
    base = base.withColumn("nd_bands", F.array(F.lit(7).cast("long"), F.lit(8).cast("long"), 1000 + pair))
    found = {r["component"]: r["n"] for r in minhash.links_and_components(df, "doc_id", "text", base).groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert found == {2 * j: 2 for j in range(30)}


def test_crowded_buckets_lose_no_link(spark):
    """All documents in one bucket, each pair of near copies in no other one together."""
    rng = random.Random(29)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for j in range(30):
        own = [f"p{j}-{rng.random()}" for _ in range(60)]
        rows += [(2 * j, " ".join(common + own)), (2 * j + 1, " ".join([*common, *own[:-1], f"x{j}"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base = minhash.signatures(df, "doc_id", "text").withColumn("nd_bands", F.array(F.lit(7).cast("long"), 1000 + F.col("nd_id"), 2000 + F.col("nd_id")))
    found = {r["component"]: r["n"] for r in minhash.links_and_components(df, "doc_id", "text", base).groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert found == {2 * j: 2 for j in range(30)}


def test_prefixes_of_similar_sets_meet(spark):
    rng = random.Random(31)
    sets = []
    for _ in range(25):
        a = rng.sample(range(400), rng.randrange(1, 60))
        sets += [a, [*a[: len(a) - len(a) // 9], *(1000 + rng.randrange(10**6) for _ in range(len(a) // 20))]]
    rows = [(k, sorted(set(x))) for k, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "node long, nd_set array<long>")
    got = defaultdict(set)
    for r in minhash._prefixes(table.select("node", F.size("nd_set").cast("long").alias("nd_n"), F.col("node").alias("nd_id")), table, 85).collect():
        got[r["node"]].add(r["nd_k"])
    similar = [(a, b) for a, x in rows for b, y in rows if a < b and 100 * len(set(x) & set(y)) >= 85 * len(set(x) | set(y))]
    assert len(similar) > 10 and all(got[a] & got[b] for a, b in similar)
    assert sum(map(len, got.values())) < sum(len(x) for _, x in rows) / 4


@pytest.mark.parametrize("percent", [80, 85])
def test_bounds_of_similar_sets_hold(spark, percent):
    """Any two similar sets are within each other's bounds in a bucket, also where only one of the buckets with equal members is kept."""
    rng = random.Random(37)
    sets = [rng.sample(range(400), rng.randrange(1, 60)) for _ in range(25)]
    sets += [[*a[: len(a) - rng.randrange(1 + len(a) // 9)], *(1000 + rng.randrange(10**6) for _ in range(rng.randrange(1 + len(a) // 9)))] for a in sets * 2]
    rows = [(k, x) for k, x in enumerate(sorted({tuple(sorted(set(x))) for x in sets if x}))]
    table = spark.createDataFrame([(k, list(x)) for k, x in rows], "node long, nd_set array<long>")
    prefixes = minhash._prefixes(table.select("node", F.size("nd_set").cast("long").alias("nd_n"), F.col("node").alias("nd_id")), table, percent)
    buckets = defaultdict(list)
    for r in minhash._distinct_sets(prefixes, None).collect():
        buckets[r["nd_k"]].append(r)
    met = {(a["node"], b["node"]) for v in buckets.values() for a in v for b in v if a["nd_n"] <= b["nd_most"] and b["nd_n"] <= a["nd_most"]}
    similar = {(a, b) for a, x in rows for b, y in rows if a != b and 100 * len(set(x) & set(y)) >= percent * len(set(x) | set(y))}
    assert len(similar) > 40 and similar <= met


def test_members_out_of_bounds_are_not_compared(spark, monkeypatch):
    """One bucket of a text's copies with one word changed (linked) and with four (linked with none): rows compared grow with the members, not their square."""
    rng = random.Random(41)
    text = [f"c{i}" for i in range(150)]
    rows = []
    for i in range(240):
        own = list(text)
        for k in rng.sample(range(150), 1 if i < 120 else 1 + 3) if i else []:
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    made, write = [], common.stage

    def counted(df, label):
        out = write(df, label)
        if label == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(minhash, "stage", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base = minhash.signatures(df, "doc_id", "text").withColumn("nd_bands", F.array(F.lit(7).cast("long")))
    got = {r["nd_digest"]: r["component"] for r in minhash.links_and_components(df, "doc_id", "text", base).collect()}
    ids = {r["nd_digest"]: r["nd_id"] for r in base.collect()}
    want = brute_components(rows)
    assert {ids[d]: c for d, c in got.items()} == {i: c for i, (_, c) in want.items()}
    assert len(set(got.values())) > 60 and sum(made) < 10 * len(rows)


def test_words_of_any_length_are_told_apart(spark):
    """Thue-Morse words and their complements, equal under polynomials modulo 2^64."""
    tm = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = tm.translate(str.maketrans("ab", "ba"))
    assert len(set(hashing.word_hashes(f"{tm} {other} {tm}x {'a' * 300_000} {'a' * 300_001} {tm}".encode()).tolist())) == 5
    df = spark.createDataFrame([(1, tm), (2, other), (3, f"q {tm} r s t u"), (4, f"q {other} r s t u"), (5, tm)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 3), 4: (2, 4), 5: (1, 1)}


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    text = b"alpha beta\tgamma  alpha \n" + b"z" * 90 + b" beta " + b"z" * 90
    whole = hashing.word_hashes(text).tolist()
    assert len(whole) == 7 and whole[0] == whole[3] and whole[1] == whole[5] and whole[4] == whole[6] and len(set(whole)) == 4
    monkeypatch.setattr(hashing, "CHUNK", 7)
    assert hashing.word_hashes(text).tolist() == whole


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, and texts that share an id, are dropped by row, not by id."""
    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (2, b, "y"), (3, a, "z"), (0, b, "w"), (5, None, "n"), (5, None, "n"), (None, a, "x"), (6, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, nd_id string")
    got = sorted(map(tuple, minhash.drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, a, "x"), (0, b, "w"), (5, None, "n"), (5, None, "n"), (6, "", "e")], key=str)
    assert minhash.drop_near_duplicates(df).columns == df.columns

def test_near_duplicates_of_odd_rows(spark):
    got = minhash.near_duplicates(frame(spark)).collect()
    assert len(got) == len(odd_documents())
    assert all(r["kept"] for r in got if r["n_shingles"] == 0)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    """At the threshold itself a pair survives all steps but for some 1e-6."""
    least = minhash.least_matches()
    assert least == sorted(least) and least[-1] < minhash.MINIMA * 0.85
    rng = np.random.default_rng(1)
    matches = (rng.random((20_000, minhash.MINIMA)) < 0.85).reshape(20_000, -1, minhash.STEP).sum(2).cumsum(1)
    assert (matches >= np.array(least)).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r["a"]: r["b"] for r in minhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[102] == got[101] == 100
