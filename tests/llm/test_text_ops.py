"""Toxicity, language, mixing, WARC, tokens, personal data and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from unitweave.llm import language_id, mixing, pii, queries, token_counts, toxicity, warc

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "re", "si") for b in ("da", "fo", "ga", "hi", "ju", "ta")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "?!", "a", "é" * 5, "x" * 200_000, "日本語", "\x00\x01", "a b c", "a b c"]


def prose(rng, n, more=()):
    return " ".join(rng.choice(more) if more and rng.random() < 0.12 else rng.choice(WORDS) + rng.choice(("", "ra", "mo")) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    bad = ["grobulous", "vexheaded", "snarfling"]
    rows = [(i, prose(rng, rng.randint(8, 150), bad if i % 4 == 0 else ()), int(i % 4 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows], DOCS)
    return rows, docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, labelled):
    rows, docs, labels = labelled
    model = toxicity.fitted(docs, labels, "doc_id", "text", "toxic")
    plain = toxicity.learn(toxicity.sample(docs, labels, "doc_id", "text", "toxic"))
    assert (model.ordinary, model.toxic, model.weight.tolist()) == (plain.ordinary, plain.toxic, plain.weight.tolist())
    truth = {i: y for i, _, y in rows}
    got = toxicity.scored(docs, model).collect()
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    test = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    caught = sum(p and y for p, y in test)
    assert caught >= 0.85 * sum(y for _, y in test) and caught >= 0.95 * sum(p for p, _ in test)
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([*ODD, prose(random.Random(2), 30_000)])], DOCS)
    assert toxicity.scored(odd, model).where("score IS NULL").count() == 0
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)


def test_gains_are_those_of_plain_compression():
    """Each window's gain against separate compressors of each window, and windows against a plain cut."""
    import zstandard

    rng = random.Random(8)
    ordinary, toxic = prose(rng, 300).encode(), b" grobulous vexheaded snarfling grobulous "
    for text in [*ODD, prose(rng, 200, ["grobulous", "snarfling"]).upper()]:
        own = toxicity.windows(text)
        raw = (text or "").lower().encode()
        assert raw.startswith(own[0]) and raw.endswith(own[-1]) and all(len(w) <= toxicity.WINDOW and w in raw for w in own)
        plain = []
        for w in own:
            sizes = []
            for content in (ordinary, toxic + ordinary):
                params = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, dict_size=len(content), source_size=toxicity.WINDOW, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
                data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                sizes.append(len(zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress(w)))
            plain.append(sizes[0] - sizes[1])
        assert toxicity.gain_counter(ordinary, toxic)(text).tolist() == plain


def test_pieces_that_gain_are_the_toxic_ones(labelled):
    rows, _, _ = labelled
    cut = [w for _, t, y in rows if not y for w in toxicity.windows(t)]
    pieces = toxicity.telling_pieces([t.encode() for _, t, y in rows if y], b"".join(cut[:600]), cut[600:])
    assert {b"grobulous", b"vexheaded", b"snarfling"} == {p for p, (n, times) in pieces.items() if n > 50 and times >= 30}


def test_learning_takes_one_row_of_an_id_and_bounded_bytes(spark):
    """Clashing columns, repeated rows of an id, null and long texts."""
    docs = spark.createDataFrame([(i, t, "x", 1.0, True) for i in range(30) for t in ("b" * 100, "a" * 50, None)], "doc_id long, text string, label string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(30)] + [(None, 1, "y")], "doc_id long, toxic int, text string")
    rows = toxicity.sample(docs, labels, "doc_id", "text", "toxic")
    assert len(rows) == sum(not held(i) for i in range(30)) and {t for t, _ in rows} == {"a" * 50}
    assert len(toxicity.bounded(docs, "doc_id", "text", 220)) == 4
    out = toxicity.scored(docs, toxicity.learn(rows))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 90


def test_toxic_words_outlast_wrong_labels(labelled):
    """A few ordinary labels on texts with toxic words do not take these words out of the dictionary."""
    rows, _, _ = labelled
    bad = ["grobulous", "vexheaded", "snarfling"]
    wrong = [(f"{' '.join(bad)} {prose(random.Random(k), 30)} {k}", 0) for k in range(3)]
    model = toxicity.learn([(t, y) for i, t, y in rows if not held(i)] + wrong)
    test = [(t, y) for i, t, y in rows if held(i)]
    found = model.scorer()([t for t, _ in test]) >= 0.7
    assert sum(found[k] for k, (_, y) in enumerate(test) if y) >= 0.85 * sum(y for _, y in test)


def test_toxicity_without_labels(spark, labelled):
    _, docs, labels = labelled
    model = toxicity.fitted(docs, labels.limit(0), "doc_id", "text", "toxic")
    assert {r.score for r in toxicity.scored(docs, model).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_windows_cover_the_text():
    text = " ".join(f"é{i}" for i in range(300))
    own = toxicity.windows(text)
    raw, at = text.encode(), 0
    for w in own:
        at = raw.find(w, max(0, at - len(w)), at + len(w)) + len(w)
    assert at == len(raw) and toxicity.windows(None) == [b""]


def test_language_on_held_out_rows(spark):
    rng = random.Random(3)
    parts = {"aa": ["tion", "ing", "the", "wh"], "bb": ["schen", "ung", "der", "ö"], "cc": ["eau", "ment", "les", "é"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang) for i in range(600) for lang in [rng.choice(list(parts))]]
    docs = spark.createDataFrame([(i, t, lang if i % 7 else None, None, None) for i, t, lang in rows], DOCS)
    model = language_id.learn(language_id.sample(docs, "doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language_id.predicted(docs, model).collect()}
    test = [got[i].lang_pred == lang for i, _, lang in rows if held(i)]
    assert sum(test) >= 0.97 * len(test) and all(r.held_out == held(r.doc_id) for r in got.values())
    odd = {r.doc_id: r for r in language_id.predicted(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ODD)], DOCS), model).collect()}
    unknown = [i for i, t in enumerate(ODD) if not t or not any(c.isalpha() for c in t)]
    assert [i for i in odd if odd[i].lang_pred == "und"] == unknown and all(odd[i].score == 0 and odd[i].rejected for i in unknown)
    assert all(r.lang_pred in model.languages and 0 <= r.score <= 1 for i, r in odd.items() if i not in unknown)
    assert language_id.predicted(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.predicted(docs, language_id.learn([])).collect()} == {"und"}


def clamped(sizes, weights, total, cap):
    """Clamp and share out again, step by step."""
    fixed = {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        left, w = total - sum(fixed.values()), sum(weights[i] for i in rest)
        share = {i: left * weights[i] / w for i in rest}
        over = [i for i in rest if share[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def test_water_filling_reaches_the_fixed_point():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.choice((0, 1, 10, 100, 1000)) for _ in range(rng.randint(1, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        total = 1.5 * sum(sizes)
        got, want = mixing.water_fill(sizes, weights, total, 2.0), clamped(sizes, weights, total, 2.0)
        assert all(math.isclose(a, b or 0.0, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want))
        assert math.isclose(sum(got), total, abs_tol=1e-6)


def test_mixing(spark):
    rng = random.Random(5)
    sources = ["a", "B", "é", None, "", "empty"]
    rows = [(i, None if i % 50 == 7 else "" if s == "empty" else prose(rng, rng.randint(0, 40)).replace(" ", " \n"), None, s, None) for i in range(600) for s in [sources[i % 6] if i % 3 else "a"]]
    rows += [rows[5], (None, "x y z", None, "a", None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()), key=str)
    assert sum(r.size for r in got) == sum(len((t or "").split()) for _, t, *_ in rows)
    by: dict = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.target, r.source_size), []).append(r.taken)
    assert all(abs(sum(x) - target) <= 0.5 for (target, _), x in by.items() if len(by) == 6)
    again = mixing.repetitions(docs).collect()
    assert sum(r.taken for r in again) == sum(r.taken for r in got)
    assert all(len((r.text or "").split()) == r.taken for r in again)
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.repetitions(docs.limit(0)).count() == 0


PAGES = [(1, "http://a/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", None), (4, "u", ""), (5, "u", "é" * 3), (6, "u", "long " * 60_000), (7, "u", "<p>one</p>"), (None, "u", "<p>one</p>"), (None, "u", "lone"), (9, "u\r\nX: y", "nine"), (9, "u", "nine")]


def test_warc_round_trip(spark, monkeypatch):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, content string")
    for size in (warc.ARCHIVE_BYTES, 1):
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
        rows = warc.records(warc.archives(pages)).collect()
        first = {}
        for i, _, h in PAGES:
            if i is not None:
                first[h or ""] = min(first.get(h or "", i), i)
        want = [(i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), *(("response", None) if first.get(h or "", i) == i else ("revisit", first[h or ""]))) for i, _, h in PAGES]
        assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    assert warc.records(warc.archives(pages.limit(0))).count() == 0


def test_warc_dictionary_and_damage():
    html = [f"<html><head><title>{i}</title></head><body>{'shared words of pages ' * (i % 7)}</body></html>".encode() for i in range(400)]
    dictionary = warc.train(html, 4096)
    writer = warc.Writer(dictionary)
    for i, h in enumerate(html):
        writer.add(warc.pack_record(i, "http://x", h, None, "response", "2024-01-01T00:00:00Z"))
    archive = writer.take()
    assert dictionary and archive[:4] == (0x184D2A5D).to_bytes(4, "little") and sum(1 for m, _, _ in warc.frames(archive) if m == warc.FRAME_MAGIC) == 400
    assert [r["payload"] for r in warc.read_archive(archive)] == html
    spot = list(warc.frames(archive))[200][1] + 30
    for damaged in (archive[:-5], archive[:-1] + bytes([archive[-1] ^ 1]), archive[:spot] + bytes([archive[spot] ^ 255]) + archive[spot + 1 :], b"\0" * 20 + archive):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(damaged))
    record = warc.pack_record(1, "u", b"abc", None, "response", "d")
    for a, b in ((b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date: d\r\n", b""), (b"abc", b"abd"), (b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(record.replace(a, b, 1))


def test_token_counts_are_the_librarys(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    rng = random.Random(6)
    path = public.path(queries.VOCABULARY)
    texts = [*ODD, "it's we're I'LL 'tis ''s 's's 'sun x'!'s ΣΑΣ straße ǅ İstanbul 12345 ½ ² á <|endoftext|> <|EndOfText|>a<|startoftext|>b", "aaaaaaaaaaaaa" * 50, "\x85a\x0bb\x1cc d", "'", "a'", "👍👍🏽", "'r 're've'll'd'mm", "1'st", "'ſ", "don'ſ"]
    texts += ["".join(rng.choice("ab'std re1é.! \nΣ日") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    want = [len(e.ids) for e in tokenizers.Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = token_counts.token_counts(docs, "doc_id", "text", path).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == dict(enumerate(want))
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert token_counts.token_counts(docs.limit(0), "doc_id", "text", path).count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        total += x * 2 - (9 if x > 4 else 0) if i % 2 else x
    return total % 10 == 0


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark):
    rng = random.Random(7)
    texts = [*ODD[:6], "日本語 a@b.co", "a@b.c%d@e.f x..y@z.w.v. @a.b q@w", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111; 4111-1111-1111-1111- 4111  1111", "+49 (0) 170 1234567 +1-555-123-4567. +12 +", "👍 a@b.co 🙂 10.0.0.1", "1 2 " * 20_000, "a@b.c " * 5000, "4111111111111111 " * 400]
    texts += ["".join(rng.choice("ab1234. @+-%()👍") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string, pii_email string")
    rows = {r.doc_id: r for r in pii.pii_digest(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t[:80]
        assert [rows[i][f"n_{k}"] for k, _ in BASE] == [sum(x[0] == k for x in want) for k, _ in BASE]
    assert pii.pii_digest(docs.limit(0)).count() == 0


def test_account_numbers_context_and_redaction(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00.", "DE89370400440532013001", "mail me: a@b.co", "xx 10.0.0.1 and a@b.co, x", None]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, extra string")
    rows = {r.doc_id: r for r in pii.pii_digest(docs).collect()}
    assert rows[0].spans == "iban:5:32" and rows[0].scores == "1.00" and rows[1].spans == "" and rows[2].scores == "1.00" and rows[3].scores == "0.90,0.60"
    done = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert done == {0: "iban [IBAN].", 1: texts[1], 2: "mail me: [EMAIL]", 3: "xx [IP] and [EMAIL], x", 4: None}


def test_account_numbers_before_words_and_numbers(spark):
    """What follows an account number is not taken along, whatever it is; the texts are unknown to the SQL's greedy pattern."""
    number, bare, other = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    cases = [(f"iban {number} Please pay", [number]), (f"{bare} The bill", [bare]), (f"{bare} THE BILL", [bare]), (f"{number} 000 12", [number]), (f"日👍 {number} {other}", [number, other])]
    cases += [(f"{bare} {bare} {bare}", [bare] * 3), (f"AB12 {number}", [number]), (f"{bare}x", []), (f"{bare}X", []), (f"x{bare}", []), (f"{bare[:-1]}1 Please", []), (f"{number} a", [number]), (f"{number}, A", [number]), ("DE89 " * 5000 + number, [number])]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.pii_digest(docs).collect()}
    for i, (text, want) in enumerate(cases):
        got = [tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s.startswith("iban:")]
        assert [text[a:b] for a, b in got] == want, text[:80]


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    bad = ["grobulous", "vexheaded", "snarfling"]
    rows = [(i, prose(rng, rng.randint(40, 120), bad if i % 5 == 0 else ()), "en", f"s{i % 3}", 0) for i in range(500)]
    item = prose(rng, 30)
    rows += [(1000 + k, rows[k][1], "en", "s0", 0) for k in (1, 2)] + [(1100, "start " + item + " end", "en", "s1", 0), (1200, prose(rng, 60) + " a@b.co", "en", "s2", 0), (1300, None, None, None, None), (1301, "", "en", None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == pipeline.COLUMNS
        ids = {r.doc_id for r in docs.collect()}
        if name == "toxicity":
            assert len([i for i in range(500) if i % 5 == 0 and i not in ids]) >= 90 and len([i for i in range(500) if i % 5 and i not in ids]) <= 4
        if name == "near_duplicates":
            assert not ids & {1001, 1002} and {1, 2, 1100, 1300, 1301} <= ids
        if name == "decontamination":
            assert 1100 not in ids and {1, 2, 1200} <= ids
    assert docs.where("doc_id = 1200").first().text.endswith("[EMAIL]")
    mix = pipeline.run(spark, str(tmp_path))
    words = docs.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).first().n
    assert abs(mix.agg(F.sum("taken")).first()[0] - 1.5 * words) <= 2
