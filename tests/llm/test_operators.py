"""The operators against brute force, round trips and edge cases."""

import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from braidflow.llm import common, decontaminate, html_extract, lang_id, license_scan, media_columns, mixing, near_dup, secret_scan, token_output, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, label string, node long, bucket int"
ODD_TEXTS = [None, "", " ", "A", "\n\n", "ß Ünï 中文 😀", "the mit license " * 3, "x" * 50_000, "word " * 20_000, "token=abcdef1234", "same text here and there again", "same text here and there again"]


def documents(spark, texts):
    """Odd columns with clashing names, null ids, null languages and sources."""
    rows = [(i if i != 4 else None, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", 7, "r", "l", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]


def prose(rng, n, letters="abcdefghilmnoprst"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


# ---------------------------------------------------------------- shared


def test_word_hashes_equal_for_equal_words_only():
    texts = ["The cat, the CAT; über", "", "ü", "cat", None, "a" * 300 + " b"]
    got = []
    for _, data, off in common.blocks(pa.array(texts)):
        hashes, first = common.word_hashes(data, off)
        got += [hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    by_word = {}
    for text, hashes in zip(texts, got):
        assert len(hashes) == len(words(text))
        for w, h in zip(words(text), hashes):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_shingles_are_runs_of_words():
    texts = ["a b c d e f g", "b c d e f", "x y", "", "a b c d e"]
    (_, data, off), = common.blocks(pa.array(texts))
    hashes, first = common.shingles(*common.word_hashes(data, off), 5)
    own = [hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert list(map(len, own)) == [3, 1, 1, 0, 1] and own[0][1] == own[1][0] and own[0][0] == own[4][0]


# ---------------------------------------------------------------- 1


def test_html_parts_and_odd_markup():
    model = html_extract.default_model()
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><header><p>Site</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
        "<article><h1>A title&amp;more</h1><p>First  paragraph\n of text, with <b>bold</b> words.<p>Second one; unclosed.<div class=ad>Buy now!</div><p>Third&nbsp;one.</p></article>"
        "<section class=comments><p>I disagree, said a reader.</p></section><aside class=sidebar><p>Related</p></aside><form><p>Sign up</p></form><footer>&copy; Us</footer></body></html>"
    )
    assert html_extract.main_text(model, page) == "A title&more\n\nFirst paragraph of text, with bold words.\n\nSecond one; unclosed.\n\nThird one."
    for odd in ("", None, "<", "<p", "</p></p>", "<!-- x", "<script>never closed", "&amp;&am", "<table><tr><td>a<td>b<tr>", "<p>" * 300, "plain"):
        assert isinstance(html_extract.main_text(model, odd), str)
    fresh = html_extract.training_pages(40, seed=5)
    right = total = 0
    for source in fresh:
        parsed = html_extract.parse(source)
        p = model.marginals(parsed)
        for k, text in parsed.blocks:
            total += len(text)
            right += len(text) * ((p[k] >= 0.5) == bool(parsed.nodes[k].gold))
    assert right / total > 0.97


def test_marginals_are_exact():
    model = html_extract.fit(html_extract.training_pages(15), rounds=15)
    page = html_extract.parse("<body><div class=menu>a b</div><article><p>c, d.</p><p>e</p></article></body>")
    used = [k for k, n in enumerate(page.nodes) if n.used]
    mass = dict.fromkeys(used, 0.0)
    total = 0.0
    for bits in range(1 << len(used)):
        y = {k: bits >> i & 1 for i, k in enumerate(used)}
        score = 0.0
        for k in used:
            n = page.nodes[k]
            score += y[k] * sum(model.unary.get(f, 0.0) for f in html_extract._features(n))
            if n.parent >= 0:
                score += (model.edge.get(html_extract._edge(page, k)) or model.edge["*"])[y[n.parent]][y[k]]
        w = np.exp(score)
        total += w
        for k in used:
            mass[k] += w * y[k]
    got = model.marginals(page)
    assert all(abs(mass[k] / total - got[k]) < 1e-9 for k in used)


def test_html_on_tables(spark):
    rows = [(1, "u", "<article><p>Hello there, you.</p></article>"), (2, None, None), (3, "u", ""), (3, "u", "")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), html_extract.default_model()).orderBy("page_id").collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "Hello there, you.", 17), (2, "", 0), (3, "", 0), (3, "", 0)]


# ---------------------------------------------------------------- 2


def test_license_digest(spark):
    texts = [*ODD_TEXTS, "Released under the MIT License.", "CC BY-NC and cc by\nnc", "Licensed under the Apache License, Version 2.0.", "this work is licensed under the gnu general public license", "license MIT the"]
    docs = documents(spark, texts)
    got = license_scan.license_digest(docs).collect()
    assert len(got) == len(texts)
    for text, r in zip(texts, got):
        w, places, labels = words(text), [], set()
        for label, phrase in license_scan.BASE_PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[-2].labels == "gpl-3"
    assert license_scan.license_digest(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 3


def test_secrets(spark):
    assert [c[:3] for c in secret_scan.candidates('PassWord: "hunter22" x')] == [("assign", 0, 19)]
    assert [c[:3] for c in secret_scan.candidates("secret:token:abcdefgh")] == []  # the short match eats it
    assert [c[0] for c in secret_scan.candidates("AKIA" + "B" * 16 + " AKIAB")] == ["access"]
    assert secret_scan.candidates("to\u212aen = abcdef") == []  # a Kelvin sign is no letter k
    text = "ü token = \"" + "a1" * 12 + '"'
    got = secret_scan.candidates(text)
    assert [(k, text[a:b]) for k, a, b, _ in got] == [("assign", text[2:-1]), ("hex", "a1" * 12)]
    secret, shared = "token=9f8e7d6c5b4a", "token=0123456789ab"
    texts = [*ODD_TEXTS, secret, *[shared] * 6]
    rows = [(i, t, "en", f"s{i}" if t == shared else "mine", 1, "", "", 1, 1) for i, t in enumerate(texts)]
    out = secret_scan.secret_digest(spark.createDataFrame(rows, DOC)).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(texts)
    assert (by_id[12].n_live, by_id[12].n_example) == (1, 0) and (by_id[13].n_live, by_id[13].n_example, by_id[13].most_owners) == (0, 1, 6)
    assert by_id[0].base_sha256 == hashlib.sha256(b"").hexdigest() and by_id[12].base_sha256 == hashlib.sha256(b"assign:0:18").hexdigest()
    assert secret_scan.secret_digest(documents(spark, ODD_TEXTS)).count() == len(ODD_TEXTS)
    assert secret_scan.secret_digest(documents(spark, ODD_TEXTS).limit(0)).count() == 0


# ---------------------------------------------------------------- 4


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_signatures_and_carving():
    wav = media_columns.store(b" " * 192)
    gif = b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    import gzip

    packed = gzip.compress(b"hello")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", "b")
    for blob, kind in ((wav, "audio/wav"), (png(), "image/png"), (gif, "image/gif"), (packed, "application/gzip"), (buffer.getvalue(), "application/zip")):
        assert media_columns.sniff(blob) == (kind, [])
        assert media_columns.sniff(b"junk " + blob + b" more") == (None, [(5, len(blob), kind)])
        assert media_columns.sniff(blob[:-3])[0] is None
    damaged = bytearray(png())
    damaged[-6] ^= 1
    assert media_columns.sniff(bytes(damaged)) == (None, [])
    assert media_columns.corrected("image/jpeg", "image/png") == "image/png" and media_columns.corrected(None, None) == media_columns.UNTYPED


def test_media_round_trip(spark):
    docs = documents(spark, ODD_TEXTS)
    got = media_columns.media_digest(docs).collect()
    assert len(got) == len(ODD_TEXTS)
    want = Counter()
    for text in ODD_TEXTS:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want[len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert Counter((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    blobs = spark.createDataFrame([(bytearray(png()), "text/plain"), (None, None)], "blob binary, said string")
    assert [(r.true_type, r.fixed_type) for r in media_columns.describe_blobs(blobs, declared="said").collect()] == [("image/png", "image/png"), (None, media_columns.UNTYPED)]


# ---------------------------------------------------------------- 5


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, e in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(200):
        p = bytes(rng.choices(b"ab ", k=rng.randint(1, 12)))
        t = bytes(rng.choices(b"ab ", k=rng.randint(0, 25)))
        assert decontaminate.myers(decontaminate.Pattern(0, p, 0.1).forward, len(p), t, False)[0] == distance(p, t)


def test_every_item_within_budget_is_found():
    rng = random.Random(2)
    items = [(i, prose(rng, 20).encode()) for i in range(6)]
    matcher = decontaminate.Matcher(items, decontaminate.RATE)
    for trial in range(40):
        i, item = items[trial % 6]
        edited = bytearray(item)
        for _ in range(rng.randint(0, matcher.patterns[i].budget)):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randint(0, 1)] = bytes([rng.choice(b"abcxyz")]) * rng.randint(0, 1)
        text = prose(rng, 30).encode() + b" " + bytes(edited) + b" " + prose(rng, 30).encode()
        want = {k for k, t in items if distance(t, text) <= matcher.patterns[k].budget}
        assert {k for k, *_ in matcher.find(text)} == want and i in want


def test_decontamination_on_tables(spark):
    item = "The quick brown fox jumps over the lazy dog, and runs away from it!"
    texts = [*ODD_TEXTS, f"Before it. THE QUICK  brown fox jumped over the lazy dog and runs away from it. ü after", item]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    got = decontaminate.matches(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(12, 1, 2), (13, 1, 0)]
    r = next(r for r in got if r.doc_id == 12)
    assert texts[12][r.start : r.stop] == "THE QUICK  brown fox jumped over the lazy dog and runs away from it"
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(texts) - 2
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(texts)


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark):
    item = "The quick brown fox jumps over the lazy dog, and runs away from it!"
    rows = [(None, f"x {item}"), (None, "clean, no id"), (None, None), (7, item), (7, "clean, same id"), (7, None), (8, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert Counter(map(tuple, decontaminate.clean(docs, bench).collect())) == Counter(r for r in rows if not (r[1] or "").endswith(item))


def test_short_items_are_found_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Ünï"), (3, "cat"), (4, "?!"), (5, "x")], "item_id long, text string")
    texts = ["what is the CAPITAL of france", "Q: What was the capital of France? A:", "what is the capital of greece", "Ünï cat, cat!", "concatenate ünïx cats", "cat", "", None, "x x x", "what is the capital of frances"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.matches(docs, bench).collect()
    got = sorted((r.doc_id, r.item_id, texts[r.doc_id][r.start : r.stop], r.distance, r.item_bytes) for r in found)
    assert got == [
        (0, 1, texts[0], 0, 29), (1, 1, "What was the capital of France", 2, 29), (3, 2, "Ünï", 0, 5), (3, 3, "cat", 0, 3), (3, 3, "cat", 0, 3),
        (5, 3, "cat", 0, 3), (8, 5, "x", 0, 1), (8, 5, "x", 0, 1), (8, 5, "x", 0, 1), (9, 1, "what is the capital of france", 1, 29),
    ]
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {2, 4, 6, 7}


def test_every_short_item_within_budget_is_found():
    rng = random.Random(3)
    for _ in range(300):
        item = prose(rng, rng.randint(1, 6), "ab").encode()[:39].strip()
        matcher = decontaminate.Matcher([(1, item)], decontaminate.RATE)
        edited = bytearray(item)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(len(edited))] = rng.choice(b"abc")
        text = b" ".join(x for x in (rng.choice((b"", b"ab ba")), bytes(edited), rng.choice((b"", b"ba"))) if x)
        least = distance(b" " + item + b" ", b" " + text + b" ")
        found = matcher.find(text)
        assert bool(found) == (least <= int(decontaminate.RATE * len(item)))
        assert all(0 <= a < b <= len(text) and text[a : a + 1] != b" " != text[b - 1 : b] for _, a, b, _ in found)


# ---------------------------------------------------------------- 6


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_ids_equal_the_librarys():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rng = random.Random(4)
    texts = ["", None, "İstanbul ΣΑΣ", "don't we'll 'S x'RE 12a²½ ''tis", "a\x1cb", "<|endoftext|> hi", "é é ﬁ K 中文 😀", "t\there\x85x\xa0y", "“q” — d… €5 ×÷ °C ñ·l", "ªa µm º", *("".join(rng.choices("abcé'ß12 .,-!\n\"×", k=60)) for _ in range(200))]
    for text, ids in zip(texts, token_output.Encoder(vocabulary()).encode(pa.array(texts))):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_code_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        assert (token_output.unpack(*token_output.pack(values), n) == values).all()
    raw = token_output.segment([5, None], [2, 1], np.array([1, 300, 70000], np.uint32))
    ids, counts, ranks = token_output.read_segment(raw)
    assert ids == [5, None] and counts.tolist() == [2, 1] and ranks.tolist() == [1, 300, 70000]
    with pytest.raises(ValueError):
        token_output.read_segment(b"oops")


def test_token_output_on_tables(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    docs = documents(spark, ODD_TEXTS)
    got = sorted(token_output.encode_documents(docs).collect(), key=lambda r: r.start)
    order = sorted((i if i != 4 else None, t) for i, t in enumerate(ODD_TEXTS) if i != 4)
    start = 0
    for r, (doc_id, text) in zip(got, [(None, ODD_TEXTS[4]), *order]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    segments, _ = token_output.write_segments(docs, vocabulary(), segment_ids=50)
    token_output.export_segments(segments, str(tmp_path))
    assert sum(token_output.read_segment(f.read_bytes())[1].sum() for f in tmp_path.iterdir()) == start
    assert token_output.encode_documents(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 7


def test_budgets_go_to_siblings_first():
    leaves = [mixing.Leaf(("a", "x", "1"), 10), mixing.Leaf(("a", "y", "1"), 1000), mixing.Leaf(("b", "x", "1"), 1000)]
    mixing.budgets(leaves, 400, {"domain": {"a": 1, "b": 1}, "lang": {"x": 1, "y": 1}}, ("domain", "lang", "source"), 1)
    assert [round(x.budget) for x in leaves] == [10, 190, 200]
    leaves[1].tokens = 50
    mixing.budgets(leaves, 400, {"domain": {"a": 1, "b": 1}, "lang": {"x": 1, "y": 1}}, ("domain", "lang", "source"), 1)
    assert [round(x.budget) for x in leaves] == [10, 50, 340]
    assert mixing.fill(10, []) == [] and mixing.fill(10, [(0.0, 5.0), (1.0, 3.0)]) == [0.0, 3.0]


def test_names_without_a_weight():
    def dealt(weights):
        leaves = [mixing.Leaf(("en", "a"), 1000), mixing.Leaf(("it", "a"), 1000), mixing.Leaf(("it", "b"), 1000)]
        mixing.budgets(leaves, 60, weights, ("lang", "source"), 2)
        return [round(x.budget, 6) for x in leaves]

    assert dealt({"lang": {"en": 0.5}}) == [50, 5, 5]  # "it" weighs UNLISTED, and all sources alike
    assert dealt({}) == [30, 15, 15]
    assert dealt({"lang": {"en": 1.0, "it": 2.0}, "source": {"a": 0.3}}) == [20, 30, 10]


def test_prefixes_against_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 40)), rng.choice(["en", "de", None]), rng.choice(["s0"] * 5 + ["s1", "s2"]), 0, "", "", 1, 1) for i in range(600)]
    docs = spark.createDataFrame([*rows, *rows[:5], (None, None, None, None, 0, "", "", 1, 1)], DOC)
    got = mixing.mix(docs, 0.7).select("k0", "k1", "k2", "id", "n_tokens", "copies", F.xxhash64(F.lit(mixing.SEED), F.lit(0), "id").alias("h0"), F.xxhash64(F.lit(mixing.SEED), F.lit(1), "id").alias("h1")).collect()
    assert len(got) == 606
    groups = {}
    for r in got:
        groups.setdefault((r.k0, r.k1, r.k2), []).append(r)
    leaves = [mixing.Leaf(k, sum(r.n_tokens for r in rs)) for k, rs in groups.items()]
    mixing.budgets(leaves, 0.7 * sum(x.tokens for x in leaves), mixing.WEIGHTS, mixing.LEVELS, mixing.MAX_EPOCHS)
    for leaf in leaves:
        whole = int((leaf.budget + 1e-6) // leaf.tokens)
        left, taken = int(leaf.budget + 1e-6 - whole * leaf.tokens), set()
        by_hash = {}
        for r in groups[leaf.path]:
            by_hash.setdefault((r.h0, r.h1)[min(whole, 1)], []).append(r)
        for h in sorted(by_hash):
            left -= sum(r.n_tokens for r in by_hash[h])
            if left < 0:
                break
            taken.add(h)
        if whole < 2:
            for h, rs in by_hash.items():
                assert all(r.copies == whole + (h in taken) for r in rs), leaf
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix_digest(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 8


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(a), words(b)))
    return len(x & y) / len(x | y)


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(7)
    keys = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    x, y = keys[:300], keys[60:360]
    w = rng.uniform(0.5, 3, 400)
    want = w[60:300].sum() / w[:360].sum()
    got = []
    for shift in range(60):
        salt = np.uint64(int(rng.integers(1, 1 << 62)))
        a = near_dup.icws(common.mix(x ^ salt), w[:300])
        got.append((a == near_dup.icws(common.mix(y ^ salt), w[60:360])).mean())
    assert abs(np.mean(got) - want) < 0.03


def test_classes_against_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = prose(rng, 120).split()
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            texts.append(" ".join(copy))
    crowd = prose(rng, 200).split()  # more near copies of one text than a bucket compares in pairs
    for _ in range(40):
        copy = list(crowd)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = prose(rng, 1)
        texts.append(" ".join(copy))
    texts = [*ODD_TEXTS, *texts, *texts[:5]]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in near_dup.classes(docs).collect() if r.doc_id is not None}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    real = [i for i in range(len(texts)) if i != 4]
    for i in real:
        for j in real:
            if i < j and root(i) != root(j) and ((texts[i] or "") == (texts[j] or "") or words(texts[i]) and words(texts[j]) and jaccard(texts[i], texts[j]) >= 0.8):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: got[i].class_id for i in real} == {i: root(i) for i in real}
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {root(i) for i in real}
    assert near_dup.classes(docs.limit(0)).count() == 0


def test_plain_samples_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(8)
    got = []
    for _ in range(60):
        keys = rng.integers(0, 1 << 63, 5400).astype(np.uint64)
        got.append((near_dup.minwise(np.sort(keys[:5000])) == near_dup.minwise(np.sort(keys[600:]))).mean())
    assert abs(np.mean(got) - 4400 / 5400) < 0.03


def test_texts_of_the_same_shingles_are_linked_whatever_their_counts(spark):
    rng = random.Random(10)
    texts = []
    for _ in range(20):
        own, line = prose(rng, 12), prose(rng, 15)
        texts += [" ".join([own, *[line] * n]) for n in (3, 9, 27)]
    assert min(jaccard(texts[i], texts[i + j]) for i in range(0, 60, 3) for j in (1, 2)) >= 0.8
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 3 for i in range(60)}


def test_link_counts_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    texts = ["", "no link here", "a b c"]
    for size, edits in ((10, 2), (60, 4)):
        base = prose(rng, 150).split()
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            texts.append(" ".join(copy))
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = near_dup.idf_table(docs)
    _, data, off = next(common.blocks(pa.array(texts)))
    packed = [np.array(list(zip(k, n)), near_dup.PACKED) for k, n in near_dup.text_shingles(data, off)]
    near = [[i != j and max(near_dup._similarity(x, y, idf)) >= near_dup.THRESHOLD for j, y in enumerate(packed)] for i, x in enumerate(packed)]
    want = {i: sum(row) for i, row in enumerate(near)}
    assert want[1] == 0 and max(want.values()) > 2 * near_dup.SMALL
    assert {r.doc_id: r.n_links for r in near_dup.classes(docs, count_links=True).collect()} == want
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 7)
    assert {r.doc_id: r.n_links for r in near_dup.classes(docs, count_links=True).collect()} == want


def test_prefix_keys_lose_no_similar_pair():
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    weight = dict(zip(pool.tolist(), np.round(rng.uniform(1, 1.25, 60), 2)))
    met = pairs = 0
    for _ in range(400):
        x = rng.choice(pool, rng.integers(1, 40), replace=False)
        y = np.unique(np.concatenate((rng.choice(x, max(1, int(len(x) * rng.uniform(0.75, 1))), replace=False), rng.choice(pool, rng.integers(0, 4)))))
        wx, wy = (np.array([weight[k] for k in v.tolist()]) for v in (x, y))
        both = np.intersect1d(x, y)
        inside = sum(weight[k] for k in both.tolist())
        keys = [near_dup.prefix_keys(v, w, w, 1) for v, w in ((x, wx), (y, wy))]
        lighter, heavier = (set(k[light].tolist()) for k, light in keys), (set(k[~light].tolist()) for k, light in keys)
        (lx, ly), (hx, hy) = tuple(lighter), tuple(heavier)
        meet = bool(lx & hy or ly & hx)
        if inside / (wx.sum() + wy.sum() - inside) >= near_dup.THRESHOLD:
            pairs += 1
            assert meet
        met += meet
    assert pairs > 50 and met < 400


def test_prefix_pairs_are_few_beside_the_similar_ones(spark):
    """Texts around one long line, most of them too far from each other: no similar pair of two
    classes is lost, and hardly others meet."""
    rng = random.Random(13)
    line = prose(rng, 12)
    texts = [" ".join([prose(rng, rng.randint(5, 60)), *[line] * rng.randint(10, 14)]) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    idf = near_dup.idf_table(docs)
    sets = near_dup._sets(docs)
    got = [(r.a, r.b) for r in near_dup._prefix_pairs(sets.selectExpr("node", "node DIV 2 AS label", "2L AS size", "shingles"), idf).collect()]
    packed = {r.node: np.frombuffer(r.shingles, near_dup.PACKED) for r in sets.collect()}
    want = {(a, b) for a in packed for b in packed if a < b and a // 2 != b // 2 and max(near_dup._similarity(packed[a], packed[b], idf)) >= near_dup.THRESHOLD}
    assert len(got) == len(set(got)) and want <= set(got)
    assert 50 < len(want) and len(got) <= 2 * len(want)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 4), (20, 21), (22, 21), (5, 5)], "a long, b long")
    assert dict(map(tuple, near_dup.components(edges).collect())) == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 20: 20, 21: 20, 22: 20}


# ---------------------------------------------------------------- 9


def test_language_id(spark):
    rng = random.Random(6)
    alphabets = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}
    rows = [(i, prose(rng, 40, alphabets[lang]), lang) for i, lang in enumerate(list(alphabets) * 40)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 !", "bb"), (1003, "x" * 30_000, None), (None, prose(rng, 30, "abcdefg"), None)]
    docs = spark.createDataFrame([(*r, "lang_pred clash") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in lang_id.identify(docs.drop("lang_pred")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].rejected and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values()) and not any(got[i].rejected for i in range(120))
    assert [r.lang_pred for r in lang_id.identify(docs.where("doc_id >= 1001")).collect()] == ["und"] * 3
    assert lang_id.identify(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 10


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        text = ". ".join(prose(rng, 8) for _ in range(rng.randint(2, 8)))
        if i % 3 == 0:
            text += f". {prose(rng, 2)} zzgrob{rng.choice('abc')} {prose(rng, 2)}. {prose(rng, 5)}."
        rows.append((i, text))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (None, "a b"), (1003, "zzgroba " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_digest(docs, known).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].predicted == int(i % 3 == 0) for i in range(400)) >= 390
    assert got[1000].score == got[1001].score == got[1002].score == 0 and got[1003].predicted == 1
    held = toxicity.F.coalesce(common.crc32_mod("doc_id", 5) == 0, toxicity.F.lit(True))
    found = toxicity.score(docs, toxicity.fit(docs, known, ~held)).where("doc_id = 3").first()
    assert any("zzgrob" in rows[3][1][s.start : s.stop] for s in found.offending) and len(found.offending) == 1
    assert max(r.score for r in toxicity.toxicity_digest(docs, known.limit(0)).collect()) < 1e-4  # nothing learned: no document is toxic
    assert toxicity.toxicity_digest(docs.limit(0), known).count() == 0
