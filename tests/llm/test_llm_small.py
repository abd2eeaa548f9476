"""Each operator against a plainer version on small and odd inputs: nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import bpe, chat, gif, graph, jaccard, packing, pii, quality, rules, toxicity, trees, urls
from threadloom.llm.common import slices, tokenizer_path

ODD = ["", None, " ", "\n\t", "a", "the the the", "<|endoftext|>", "Σίσυφος ΟΔΟΣ Σ's", "é ü　 z 漢字 👍🏽 İ", "a  b \n c\x1cd \x00", "don't 'LL 12 3.5 ½", "x" * 3000, "word " * 3000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, start int, kept string"


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, None, None, None, i, "x") for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_slices_hold_everything():
    assert list(slices([])) == []
    assert list(slices([5, 5, 20, 1], 10)) == [(0, 2), (2, 3), (3, 4)]


# byte-pair encoding


def test_trie_encodes_as_the_library(spark):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("abcdeäé -',.1") for _ in range(40)) for _ in range(200)] + ["same", "same"]
    found = by_id(bpe.encode_documents(documents(spark, texts)))
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()), t
    assert bpe.encode_documents(empty(spark)).count() == 0


# personal data


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and doubled % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


@pytest.mark.parametrize("letters", ["a@.-1 ", "0123456789. -", "+1 2()3.-4", "a@b.c@d-e%", "1.2.3.4.5 .+"])
def test_base_spans(letters):
    r = random.Random(letters)
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    assert pii.base_spans("1" * 300_000) == [] and pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("+1 " * 50_000 + "(" * 100_000) == []


def personal(i):
    r = random.Random(i)
    part = "".join(r.choice("abcdefgh") for _ in range(6))
    body = "4" + "".join(r.choice("0123456789") for _ in range(14))
    card = next(body + c for c in "0123456789" if pii.luhn(body + c))
    return {"email": f"{part}.{i}@site{i % 7}.example.org", "ip": ".".join(str(r.randrange(1, 255)) for _ in range(4)), "card": card, "phone": f"+1 ({i % 900 + 100}) 555-{i:04d}"}


def test_pii_adds_spans_and_redacts(spark):
    r = random.Random(4)
    filler = lambda n: " ".join(r.choice("the of 12 and (see) is, house. To x 7.5 run -- green \"so\" ask call pay host | mail 2024 it".split()) for _ in range(r.randrange(n)))
    own = [f"{filler(9)} {x} {filler(9)}".strip() for i in range(300) for x in personal(i).values()]
    clean = ["pay 4539148803436460 now", "he was at the door. The end", "in 1999-2000 or 1999 - 2004 it", "host 300[.]20[.]30[.]40 is", "token = \"5d190bd7c06284de91015a36974748794293dd8a\""]
    texts = ODD + own + clean + ["mail a.b@c-d.example.org at 10.0.0.1"]
    docs = documents(spark, texts)
    found = by_id(pii.judge(docs))
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        spelled = [f"{k}:{a}:{b}" for k, a, b in base]
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert set(spelled) <= set(found[i]["spans"].split(",")) | {""}
    # slips that it wasn't taught are found, and look-alikes aren't
    finder, hit, wrong = pii.fit(docs), Counter(), 0
    for i in range(1000, 1200):
        for kind, form in personal(i).items():
            real, fake = pii.slipped(kind, form, random.Random(i))
            for slip, t in ((real, f"then see {real} now it"), (None, f"then see {fake} now it")):
                base, spans = finder.find([t])[0]
                hit[kind] += slip is not None and (kind, 9, 9 + len(real)) in spans
                wrong += slip is None and len(spans) > len(base)
    assert min(hit[k] for k in pii.KINDS) >= 140 and wrong <= 0.1 * sum(hit.values()), (hit, wrong)
    by_text = {t: pii.spelled(finder.find([t])[0][1]) for t in clean}
    assert {by_text[t] for t in clean} == {""}
    new = by_id(docs.withColumn("text", pii.redacted(F.col("text"), pii.fit(docs))))
    assert new[1]["text"] is None and new[0]["text"] == "" and new[len(texts) - 1]["text"] == "mail [EMAIL] at [IP]"
    assert pii.judge(empty(spark)).count() == 0


def test_thresholds_count_all_documents(spark, monkeypatch):
    docs = documents(spark, [f"see {x} now {i}" for i in range(600) for x in personal(i).values()])
    seen, bounds_of = [], pii.bounds_of
    monkeypatch.setattr(pii, "bounds_of", lambda cells: seen.append(cells) or bounds_of(cells))
    pii.fit(docs, max_docs=200)
    apart = {k: sum(n for (kind, label, own, step), n in seen[0].items() if kind == k and label == 1 and not own and step >= 0) for k in pii.KINDS}
    # all but some 150 of 2,400 texts, each with a slip, tell the thresholds; base spans are those of all
    assert min(apart.values()) >= 450, apart
    assert all(seen[0][k, 2, True, -1] >= 600 for k in pii.KINDS)


def test_slips_are_candidates_and_look_alikes_are_not_base():
    seen = Counter()
    for i in range(400):
        for kind, own in personal(i).items():
            real, fake = pii.slipped(kind, own, random.Random(i))
            assert pii.base_spans(own) == [(kind, 0, len(own))]
            assert (kind, 0, len(real)) in set(pii.candidates(real)) or pii.base_spans(real), real
            assert (kind, 0, len(fake)) not in pii.base_spans(fake) or kind == "ip", fake
            seen[kind] += (kind, 0, len(real)) in pii.beside_base(real, pii.base_spans(real))
    assert min(seen.values()) > 300


def test_overlap_takes_linear_time():
    import time

    finder = pii.Finder(trees.BoostedTrees(trees=2).fit(np.random.default_rng(1).random((40, 37)), np.r_[np.zeros(20), np.ones(20)]), dict.fromkeys(pii.KINDS, 0.0))
    took = []
    for n in (2000, 16_000):
        began = time.perf_counter()
        (base, spans), = finder.find(["Call 017 555 7713 or 1.2.3.4 at x. " * n])
        took.append(time.perf_counter() - began)
        assert len(base) == n and len(spans) >= 2 * n
    assert took[1] < 24 * took[0] + 1


def test_boosted_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    p = trees.BoostedTrees().fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95


# media


def test_lzw_that_never_clears_a_full_table():
    data, bits = random.Random(5).randbytes(200_000), 8
    codes, wide = np.array([1 << bits, *data, (1 << bits) + 1]), np.array([bits + 1, *gif._widths(len(data) + 1, bits)])
    places = np.arange(gif.MAX_BITS)
    stream = np.packbits(((codes[:, None] >> places) & 1).astype(bool)[places < wide[:, None]], bitorder="little").tobytes()
    assert gif.lzw_decode(stream, bits, len(data)) == data


@pytest.mark.parametrize("bits", [2, 3, 8])
def test_lzw_round_trip(bits):
    r = random.Random(bits)
    for n in (0, 1, 2, 300, 9000, 60_000):
        for data in (bytes(r.randrange(1 << bits) for _ in range(n)), bytes(n), bytes(i // 3 % (1 << bits) for i in range(n))):
            assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, n) == data


def test_gif_composes_frames():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    full = np.full((4, 4), 1)
    part = np.array([[2, 3], [3, 2]])
    data = gif.encode_gif([gif.Frame(full, disposal=1), gif.Frame(part, 1, 1, 5, 3, transparent=3), gif.Frame(part, 0, 0, 7, 2), gif.Frame(np.full((1, 1), 3), 3, 3, interlaced=True)], 4, 4, palette)
    shown = list(gif.shown_frames(data))
    assert [(b, t) for b, t, _, _ in shown] == [(0, 100), (100, 50), (150, 70), (220, 100)]
    second, third, fourth = (c[:, :, :3].tolist() for _, _, _, c in shown[1:])
    assert second[1][1] == [0, 255, 0] and second[1][2] == [255, 0, 0]
    assert third[1][1] == [0, 255, 0] and third[2][2] == [255, 0, 0]
    assert shown[3][3][0, 0, 3] == 0 and fourth[3][3] == [0, 0, 255]
    assert gif.histogram(shown[0][3])[48] == 16
    with pytest.raises(ValueError, match="GIF"):
        gif.stored_frames(b"nope")
    with pytest.raises(ValueError):
        gif.stored_frames(data[:60])


def test_image_from_another_encoder():
    # ten by ten, four colours, written by hand as a well-known sample of the format
    data = bytes.fromhex("47494638396 10A000A00910000FFFFFFFF00000000FF00000021F90400000000002C000000000A000A0000 0216 8C2D99872A1CDC33A00275EC95FAA8DE608C04914C0100 3B".replace(" ", ""))
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    width, height, _, found = gif.stored_frames(data)
    assert (width, height, len(found)) == (10, 10, 1)
    assert ["".join(map(str, r)) for r in found[0].indices.reshape(10, 10).tolist()] == rows
    (_, _, _, canvas), = gif.shown_frames(data)
    colours = [[255, 255, 255], [255, 0, 0], [0, 0, 255]]
    assert canvas[:, :, :3].tolist() == [[colours[int(c)] for c in r] for r in rows]


def test_odd_tables(spark):
    none = labels(spark, [])
    for frame in (gif.store_documents(empty(spark)), toxicity.judge(empty(spark), none), packing.pack(empty(spark)), rules.judge(empty(spark), none)):
        assert frame.count() == 0


def test_interlaced_rows():
    image = np.arange(13 * 5).reshape(13, 5) % 256
    stored = gif.stored_frames(gif.encode_gif([gif.Frame(image, interlaced=True)], 5, 13))[3][0]
    assert (stored.indices == image).all()


def test_media_digest(spark):
    texts = ODD + ["y" * (gif.ROW * gif.ROWS + 1)]
    found = by_id(gif.store_documents(documents(spark, texts)))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + b" " * (-len(raw) % 192) or b" " * 192
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert found[0]["media_sha256"] == found[1]["media_sha256"]
    images = spark.createDataFrame([(1, bytearray(gif.store(gif.payload("ab")))), (2, None)], "id long, image binary")
    rows = gif.frames(images).select("id", "frame.*").collect()
    assert len(rows) == 1 and sum(rows[0]["colours"]) == 192


# packing


def test_pieces_and_ids_as_the_library(spark):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = ODD + [f"text number {i} is here, and so on. " * (i % 40) for i in range(120)] + ["same one", "same one"]
    rows = packing.pack(documents(spark, texts)).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert len(pieces) == len(texts)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r["length"] for r in rows)
    assert len(at) <= 1.1 * total / 1024 + 2
    assert packing.pack(empty(spark)).count() == 0


def test_plan_packs_each_piece_once_and_swaps():
    r = random.Random(3)
    for _ in range(20):
        counts = Counter(r.randrange(1, 1024) for _ in range(r.randrange(1, 4000)))
        used = Counter()
        for times, uses in packing.plan(counts):
            assert sum(k * n for k, n in uses.items()) <= 1024
            used.update({k: n * times for k, n in uses.items()})
        assert used == counts
    # 600 and then 300 leave a gap of 124; 300 gives way to 212 + 212, which fill the bin
    assert packing.plan({600: 1, 300: 1, 212: 2})[0] == (1, {600: 1, 212: 2})


# quality rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark):
    import xxhash

    r = random.Random(5)
    good = [" ".join(r.choice(["the", "of", "Alpha", "beta", "gamma,", "delta."]) + str(r.randrange(30)) for _ in range(80)) for _ in range(30)]
    junk = [" ".join("".join(r.choice("#$%&*QZX") for _ in range(6)) for _ in range(80)) for _ in range(6)]
    texts = ODD + ["a b c a b c\n\na b c\n x \n x \n", "a a a a"] + good + junk
    n = len(texts)
    marks = labels(spark, [(i, 1, 0) for i in range(n - 36, n - 6)] + [(n - 1, 0, 0), (n - 2, 1, 0), (n - 2, 0, 0), (None, 1, 1)])
    found = by_id(rules.judge(documents(spark, texts), marks))
    for i, t in enumerate(texts):
        f = found[i]
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == plain_counts(t or "")
        assert f["base_failed"] == (f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]) and not (f["base_failed"] and f["kept"])
    assert all(found[i]["kept"] for i in range(n - 36, n - 6)) and not any(found[i]["kept"] for i in range(n - 6, n))
    # the score against a plain computation
    def shape(w):
        return re.sub(r"\d+", "0", re.sub(r"[^\W\d_A]+", "a", re.sub(r"[A-Z]+", "A", w)))

    def cells(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        shaped = [shape(w) for w in words]
        h = lambda parts: _chained(xxhash, parts) % rules.BUCKETS
        return [h([w.lower()]) for w in words] + [h([" ", s, *shaped[i + 1 : i + 2]]) for i, s in enumerate(shaped)]

    plain = {i: cells(texts[i]) for i in range(n - 36, n)}
    raw = Counter(c for t in texts for c in cells(t or ""))
    trusted = Counter(c for i in range(n - 36, n - 6) for c in plain[i])
    for i, own in plain.items():
        score = np.mean([np.log((trusted[c] + 1) / (sum(trusted.values()) + rules.BUCKETS)) - np.log((raw[c] + 1) / (sum(raw.values()) + rules.BUCKETS)) for c in own])
        assert found[i]["score"] == pytest.approx(score, abs=1e-6)
    assert rules.judge(empty(spark), marks).count() == 0


def test_all_trusted_documents_count(spark):
    # where every document is trusted, both models are the same
    docs = spark.range(20_050).select(F.col("id").alias("doc_id"), F.lit("clear water").alias("text"))
    marks = spark.range(20_050).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert set(rules.weights(rules.counts(docs), marks).first()["weights"]) == {0.0}
    # and a document that one label calls poor isn't trusted
    assert rules.trusted_ids(marks.union(marks).union(spark.createDataFrame([(7, 0, 0)], marks.schema))).count() == 20_049


def test_only_what_may_be_trusted_is_dealt(spark, monkeypatch):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id").alias("text"))
    base, ids = rules.counts(docs), spark.range(0, 4000, 40).select(F.col("id").alias("_trusted"))
    held = {r["_id"] for r in rules.maybe_trusted(base, ids).select("_id").collect()}
    assert {*range(0, 4000, 40)} <= held and len(held) < 1000
    assert rules.maybe_trusted(base, ids.limit(0)).count() == 0
    # a filter too small to tell loses nothing, and the join stays exact
    marks = ids.select(F.col("_trusted").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    first = rules.weights(base, marks).first()["weights"]
    monkeypatch.setattr(rules, "MAX_BITS", 64)
    assert rules.weights(base, marks).first()["weights"] == first


def _chained(xxhash, parts):
    """Spark's xxhash64 of several strings: each one's hash is the next one's seed."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
    return seed


# chat


def test_chat_round_trip_and_long_conversation(spark):
    texts = ["</s>[INST] ok [/INST]", None, "\\.<\\s>", "\\\\", "a<s>\n</s>\n", "", "plain"]
    rows = [(1, i, ["system", "user", "assistant"][i % 3], texts[i % len(texts)]) for i in range(7)]
    rows += [(2, i, ["user", "assistant"][i % 2], f"turn {i} [INST]") for i in range(300)] + [(None, 0, None, "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.digest(turns).collect()}
    groups = {}
    for c, t, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert found.keys() == groups.keys()
    for c, own in groups.items():
        loss = "".join(x for role, x in own if role == "assistant")
        r = found[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.template(own)))
        assert not r["rewrites_history"]
    for text in texts:
        assert chat.unescape(chat.escape(text or "")) == (text or "") and not any(c in chat.escape(text or "") for c in chat.CONTROL)
    assert chat.digest(turns.limit(0)).count() == 0
    spans = chat.formatted(turns.filter("conv_id = 3")).orderBy("n").collect()
    assert [chat.unescape(r["formatted"][r["begins"] : r["ends"]]) for r in spans] == ["n", "a", "b"]


def test_rewriting_templates_are_detected():
    counting = lambda turns: f"{len(turns)} turns: " + chat.template(turns)
    assert chat.render([("user", "a"), ("assistant", "b")], counting).spans is None
    assert chat.render([("user", "a"), ("assistant", "b")], chat.template).texts is not None


@pytest.mark.parametrize("at", [3, 150, 200])
def test_late_rewrites_are_detected(spark, at):
    def late(turns):
        return chat.template(turns) if len(turns) < at else "cut\n" + chat.template(turns[-at // 2 :])

    rows = [(c, i, ("user", "assistant")[i % 2], f"t{i}", 1.5) for c, n in ((1, at - 1), (2, at + 40)) for i in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns double")
    found = {r["conv_id"]: r for r in chat.digest(turns, late).collect()}
    whole = late([(role, text) for c, _, role, text, _ in rows if c == 2])
    assert not found[1]["rewrites_history"] and found[1]["n_turns"] == at - 1
    assert found[2]["rewrites_history"] and found[2]["formatted_chars"] == len(whole)
    # undeclared, a local template gives what the declared one gives
    plain = chat.digest(turns, lambda t: chat.template(t)).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, chat.digest(turns).collect()))


# urls


def test_url_rules_and_models(spark):
    rows = [(i, f"https://h{i}.example.com/en/{i}") for i in range(60)] + [(100 + i, f"https://h{i}.example.net/de/{i % 7}") for i in range(60)]
    rows += [(200, None), (201, "no host"), (202, "HTTP://A.EXAMPLE.COM/en/7?x"), (203, "x://EXAMPLE.net/de/8#a"), (204, "https://notcom/en/"), (205, "https://h7.example.nets/de/3"), (206, "https://h7.example.coms/en/33"), (207, "a://É.org/es/")]
    pages = spark.createDataFrame([(*r, "h", 1.0) for r in rows], "page_id long, url string, html string, score double")
    found = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert (found[200]["host"], found[200]["path"], found[201]["host"]) == ("", "", "")
    assert (found[202]["host"], found[202]["path"], found[202]["rule"], found[202]["verdict"]) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (found[203]["rule"], found[203]["verdict"]) == ("example.net/de/8", "block") and found[204]["rule"] is None
    assert found[205]["score"] > found[206]["score"] and found[207]["host"] == "É.org"
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_scores_and_threshold_as_plainly_counted(spark):
    r = random.Random(8)
    rows = [f"https://{''.join(r.choice('abé') for _ in range(r.randrange(9)))}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'es', 'fr'])}/{r.randrange(99)}" for _ in range(300)]
    rows += [rows[0]] * 40 + ["x://h/" + "ab" * 3000, "x://", None, ""]
    pages = spark.createDataFrame([(i, u, "s") for i, u in enumerate(rows)], "page_id long, url string, text string")
    found = {x["page_id"]: x for x in urls.judge(pages).collect()}
    assert len(found) == len(rows)
    texts = {i: x["host"] + x["path"] for i, x in found.items()}
    ruled = {i: x["verdict"] for i, x in found.items() if x["rule"] is not None}
    both, context = Counter(), Counter()
    grams = lambda t: [("\x02" * 5 + t + "\n")[i : i + 6] for i in range(len(t) + 1)]
    for i, verdict in ruled.items():
        if zlib.crc32(texts[i].encode()) % 5:
            for g in grams(texts[i]):
                for k in range(6):
                    both[verdict, g[5 - k :]] += 1
                    context[verdict, k, g[5 - k : 5]] += 1

    def chance(verdict, g):
        p = 1 / 256
        for k in range(6):
            p = (both[verdict, g[5 - k :]] + urls.LEAN * p) / (context[verdict, k, g[5 - k : 5]] + urls.LEAN)
        return p

    for i, t in texts.items():
        own = grams(t)
        assert found[i]["score"] == pytest.approx(np.mean([np.log(chance("allow", g) / chance("block", g)) for g in own]), abs=1e-8)
    bins = Counter((int(np.floor(found[i]["score"] / urls.BIN)), v) for i, v in ruled.items() if zlib.crc32(texts[i].encode()) % 5 == 0)
    least = urls.threshold([(*k, n) for k, n in bins.items()])
    share = lambda x: np.mean([found[i]["score"] < x for i, v in ruled.items() if (v == "allow") and zlib.crc32(texts[i].encode()) % 5 == 0]) + np.mean([found[i]["score"] >= x for i, v in ruled.items() if v == "block" and zlib.crc32(texts[i].encode()) % 5 == 0])
    assert share(least) <= min(share(x) for x in np.arange(-5, 5, 0.01)) + 1e-9
    for i, x in found.items():
        assert x["verdict"] == ruled.get(i, "allow" if x["score"] >= least else "block")


# graph and near copies


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    roots = {x: x for p in pairs for x in p}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        roots[max(a, b)] = min(a, b)
    joined = {x for a, b in pairs if a != b for x in (a, b)}
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: find(x) for x in joined}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("large", [10_000, 5])
def test_near_copies_against_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [t for t in ODD if t is None or len(t) < 100]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randrange(4, 90))]
        for _ in range(8):
            own = base[:]
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts.append(" ".join(own))
    base = [r.choice(vocabulary) for _ in range(150)]
    texts += [" ".join(base[:k] + ["new"] + base[k:]) for k in range(60)] + [" ".join(base)] * 5
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append((tuple(w), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    first = {}
    for i, (w, _) in enumerate(sets):
        first.setdefault(w, i)
    reps, links, root = sorted(first.values()), Counter(), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (w, _) in enumerate(sets):
        root[i] = first[w]
    for k, a in enumerate(reps):
        for b in reps[:k]:
            x, y = sets[a][1], sets[b][1]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
    rows = documents(spark, texts)
    found = by_id(jaccard.classes(rows.union(rows.filter("doc_id = 20")), large))
    for i, (w, _) in enumerate(sets):
        assert (found[i]["class_id"], found[i]["copy_id"], found[i]["n_links"]) == (find(i), first[w], links[first[w]]), texts[i]
    kept = jaccard.one_of_each(rows.union(rows.filter("doc_id = 0")).union(rows.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), large)
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({find(i) for i in range(len(texts))})
    assert jaccard.classes(empty(spark)).count() == 0


def test_ids_that_repeat_lose_no_text(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue grey white black")
    rows = spark.createDataFrame([(1, a, "k"), (1, b, "k"), (2, b, "k"), (3, c, "k"), (3, c, "k"), (3, None, "k"), (4, a + " seven", "k")], "doc_id long, text string, _key string")
    kept = jaccard.one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"]) == sorted([(1, a), (1, b), (3, c), (4, a + " seven")])
    assert sum(r["text"] is None for r in kept.collect()) == 1
    found = sorted(tuple(r) for r in jaccard.classes(rows).collect())
    assert found == sorted([(1, 1, 1, 1, 0), (1, 1, 1, 2, 0), (2, 1, 1, 2, 0), (3, 3, 3, 2, 0), (3, 3, 3, 2, 0), (3, 3, 3, 1, 0), (4, 4, 4, 1, 0)])


def test_edges_of_each_depth_connect_its_buckets(spark):
    r = np.random.default_rng(3)
    sigs = r.integers(0, 2, (300, jaccard.MINIMA)).astype(np.uint16)
    reps = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "node long, sig binary").repartition(3)
    edges = [tuple(e) for e in jaccard.forest_edges(reps, 3).collect()]
    for depth in (3, 7, jaccard.FULL_DEPTH):
        root = list(range(300))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        buckets = {}
        for i, s in enumerate(sigs):
            for tree in range(jaccard.TREES):
                first = buckets.setdefault((tree, s[jaccard._CHOICES[tree][:depth]].tobytes()), i)
                x, y = find(first), find(i)
                root[max(x, y)] = min(x, y)
        own = list(range(300))
        for a, b, d in edges:
            if d >= depth:
                x, y = find(a, own), find(b, own)
                own[max(x, y)] = min(x, y)
        assert [find(i) for i in range(300)] == [find(i, own) for i in range(300)]


def test_matched_depth_meets_the_target():
    depth = jaccard.matched_depth()
    assert jaccard.expected_recall(depth) >= jaccard.TARGET > jaccard.expected_recall(depth + 1)


# classifiers


def corpus(spark, n=260):
    r = random.Random(8)
    plain = ["river", "stone", "window", "garden", "paper", "morning", "letter", "green"]
    texts, marks = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(30, 120))]
        toxic, poor = i % 3 == 0, i % 4 == 0
        if toxic:
            for _ in range(5):
                words[r.randrange(len(words))] = r.choice(["grubscum", "vilefool"])
        text = " ".join(words) + "."
        texts.append(text.upper().replace(" ", "!! ") if poor else text)
        marks.append((i, int(not poor), int(toxic)))
    return documents(spark, texts), labels(spark, [*marks, (5, None, None), (None, 1, 1)]), marks


def test_toxicity_learns_and_ignores_held_out_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 90)
    docs, marks, truth = corpus(spark)
    odd = spark.createDataFrame([(1000 + i, t, None, None, None, None, 0, "") for i, t in enumerate(ODD)] + [(None, "x", None, None, None, None, 0, "")], DOCS)
    found = by_id(toxicity.judge(docs.union(odd), marks))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values()) and len(found) == len(truth) + len(odd.collect())
    held = [(i, t) for i, _, t in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] for i, _ in held)
    assert sum(found[i]["predicted"] == t for i, t in held) >= 0.9 * len(held)
    none = by_id(toxicity.judge(docs, marks.filter("toxic = 0")))
    assert {r["score"] for r in none.values()} == {0.0}


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        spans = toxicity.windows_of(n)
        assert {i for a, b in spans for i in range(a, b)} == set(range(n)) and all(b - a <= toxicity.WINDOW for a, b in spans)


def test_logits_word_by_word():
    network = toxicity.Network(3)
    p = {k: v.astype(float) for k, v in network.p.items()}
    h = toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def window(words):
        x = [np.concatenate([p["words"][toxicity.word_row(w)], np.mean([p["letters"][i] for i in toxicity.letter_rows(w)], axis=0)]) @ p["into"] + p["bias"] for w in words]
        states = np.zeros((len(words), 2 * h))
        for way in (0, 1):
            state = np.zeros(h)
            for t in range(len(words)) if way == 0 else reversed(range(len(words))):
                own, hu = x[t][way * 3 * h : (way + 1) * 3 * h], state @ p["back"][way]
                z, r = sig(own[:h] + hu[:h]), sig(own[h : 2 * h] + hu[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(own[2 * h :] + r * hu[2 * h :])
                states[t, way * h : (way + 1) * h] = state
        weight = np.exp(np.tanh(states @ p["look"]) @ p["key"]) if len(words) else np.zeros(0)
        return float((weight / max(weight.sum(), 1e-9)) @ states @ p["out"] + p["level"][0])

    r = random.Random(2)
    texts = ["", "one", "one two, one", " ".join(r.choice("abc é dé xyz word".split()) for _ in range(150))]
    plain = []
    for t in texts:
        words = toxicity.WORD.findall(t.lower())
        plain.append(max(window(words[a:b]) for a, b in toxicity.windows_of(len(words))))
    assert toxicity.Scorer(network).logits(texts) == pytest.approx(plain, abs=1e-3)


def test_network_gradients():
    network = toxicity.Network(1)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    words, rows = toxicity.numbered(["one two three two", "four one"])
    index, mask, _ = toxicity.laid_out(rows)

    def loss():
        gates, _ = network.inputs(words)
        return float(network.forward(gates.astype(np.float64), index, mask)[0].sum())

    gates, back = network.inputs(words)
    logit, kept = network.forward(gates, index, mask, keep=True)
    g = network.gradients(gates, back, index, mask, kept, np.ones(len(logit)))
    for name, at in (("out", (3,)), ("key", (2,)), ("look", (4, 1)), ("back", (1, 2, 5)), ("into", (6, 40)), ("words", (toxicity.word_row("two"), 4)), ("letters", (toxicity.letter_rows("one")[1], 2))):
        old = network.p[name][at]
        network.p[name][at] = old + 1e-2
        high = loss()
        network.p[name][at] = old - 1e-2
        low = loss()
        network.p[name][at] = old
        assert g[name][at] == pytest.approx((high - low) / 2e-2, rel=0.05, abs=2e-3), name


def test_quality_cotraining(spark):
    docs, marks, truth = corpus(spark)
    odd = spark.createDataFrame([(1000 + i, t, None, None, None, None, 0, "") for i, t in enumerate(ODD)], DOCS)
    found = by_id(quality.judge(docs.union(odd), marks))
    assert sum(found[i]["good"] == q for i, q, _ in truth) >= 0.95 * len(truth) and len(found) == len(truth) + len(ODD)
    assert {r["score"] for r in by_id(quality.judge(docs, marks.limit(0))).values()} == {1.0}
    assert quality.judge(empty(spark), marks).count() == 0


def test_views_are_separate_and_teach_from_all_documents(spark, monkeypatch):
    r = random.Random(6)
    # stored fields tell the kinds apart where texts are new, and texts where fields are missing
    rows, marks = [], []
    for i in range(900):
        good = i % 3 > 0
        words = [f"{'fine' if good else 'junk'}{r.randrange(40)}" for _ in range(30)] if i < 600 else [f"{'calm' if good else 'loud'}{r.randrange(40)}" for _ in range(30)]
        rows.append((i, " ".join(words), "en", ("a" if good else "b") if i >= 200 or i % 2 else None, 200 if good else 9000, 0.0, 0, "x"))
        if i < 300:
            marks.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, DOCS)
    assert quality.page("en", "a", 5.0) == quality.page("en", "a", 5.0) and len(quality.layout("a b")) == 13
    model = quality.fit(docs, labels(spark, marks))
    own = docs.select("doc_id", quality.score(docs, model).alias("s")).collect()
    assert np.mean([(x["s"] >= 0.5) == (x["doc_id"] % 3 > 0) for x in own if x["doc_id"] >= 300]) >= 0.97
    # without the text, the view of words is at a loss for the new words, unless the other view has taught it
    frame = pd.DataFrame({"text": ["calm1 calm2 calm3", "loud1 loud2 loud3"], "lang": "en", "source": None, "n_chars": None})
    taught_text = model.text.logits(*(lambda f: (f.rows, f.numbers))(quality.Features.of(frame, quality.Words())))
    assert taught_text[0] > taught_text[1] + 1
    repeated = docs.union(docs)
    assert len({(x["doc_id"], x["score"]) for x in quality.judge(repeated, labels(spark, marks)).collect()}) == 900


def test_surest_share():
    assert quality.surest({0: 10, 500: 980, 999: 10}, 0.5) == (0.001, 0.999)
    # nothing is taught that a view isn't sure of
    low, high = quality.surest({400: 50, 600: 50}, 0.5)
    assert low <= 1 - quality.SURE and high >= quality.SURE


def test_layout_reads_whole_texts():
    r = random.Random(4)
    head = " ".join(r.choice(["river", "garden", "stone", "cloud", "winter"]) + str(r.random()) for _ in range(4000))[:65_536]
    same, other = head + "buy now! " * 20_000, head + "".join(r.choice("abcdefghij \n") for _ in range(180_000))
    packed = [quality.layout(t)[12] for t in (head, same, other, "")]
    assert packed == [len(zlib.compress(t.encode(), 1)) / max(1, len(t)) if t else 0.0 for t in (head, same, other, "")]
    assert packed[1] < packed[0] / 2 < packed[2]


# the whole pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, marks, truth = corpus(spark)
    docs = docs.union(docs.filter("doc_id = 7").withColumn("doc_id", F.lit(5000).cast("long"))).union(spark.createDataFrame([(6000, "write to me@x.example.org please about the river and the garden " * 3, "en", None, None, None, 0, "")], DOCS))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "pii", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    ids = {r["doc_id"]: r for r in now.collect()}
    assert 5000 not in ids and "[EMAIL]" in ids[6000]["text"]
    bad = {i for i, q, t in truth if not q or t}
    assert len(bad & ids.keys()) <= 0.1 * len(bad) and len(ids) >= 0.8 * (len(truth) - len(bad))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(ids)
    assert isinstance(packed.toPandas(), pd.DataFrame)


def test_pipeline_keeps_workers_small(spark):
    """What a stage caches doesn't stay in the workers that later stages use, and their batches are small."""
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        spark.conf.unset(key)
        docs = documents(spark, [f"river stone{i} garden word{i}, end" for i in range(400)]).repartition(4)
        assert corpus_pipeline.pack(spark, docs, "").count() == 400

        def kept(batches):
            for batch in batches:
                yield pd.DataFrame({"rows": [len(batch)], "chunks": [sum(len(t.first) + len(t.later) for t in packing._loaded.values())]})

        found = spark.range(0, 12_000, 1, 4).mapInPandas(kept, "rows long, chunks long").agg(F.max("rows"), F.sum("chunks")).first()
        assert tuple(found) == (1000, 0)
        spark.conf.set(key, 77)
        corpus_pipeline.pack(spark, docs, "")
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key)
