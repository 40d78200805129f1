"""Tokens, packing, bit files, fingerprints, HTML: against brute force and exact round trips."""

import io
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirrorfold.llm import bitfiles, htmltext, lzprint, packing, tokens

DOCS = "doc_id long, text string, extra_ long, times_ string"
ROWS = [(3, "The cat, the dog's 12 cats!", 1, "a"), (1, None, 2, "b"), (2, "", 3, None), (3, "The cat, the dog's 12 cats!", 1, "a"), (None, "no id", None, "c"), (7, "word " * 9000, 5, "d"), (8, "x" * 3000, 5, "e")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def plain_ids(text):
    return tokens.encoder(tokens.default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abZéßÉµª'´.,!|# \n\t\x1c\x85 中Σςİ́12٣½ﬁ<|>", max_size=40))
def test_words_give_the_ids_of_the_whole(text):
    ids = plain_ids(text)
    assert tokens.encoder(tokens.default_tokenizer()).ids(text.encode()) == struct.pack(f"<{len(ids)}I", *ids)


def test_letters_go_to_the_model_alone():
    made, asked = tokens.WordEncoder(tokens.default_tokenizer()), []
    ask, made._ask = made._ask, lambda texts: asked.extend(texts) or ask(texts)
    text = "Every ÉCLAIR façade ßtraße ÿñÞð, the dog's 12 cats!"
    ids = plain_ids(text)
    assert made.ids(text.encode()) == struct.pack(f"<{len(ids)}I", *ids)
    assert sorted(asked) == ["!", "'s", ",", "1", "2"]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    import bisect

    left, n = [], 0
    for length in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
        at = bisect.bisect_left(left, length)
        room = left.pop(at) if at < len(left) else 64
        n += at >= len(left) + (room != 64) and room == 64
        if room > length:
            bisect.insort(left, room - length)
    bins = {}
    for length, first_rank, end_rank, first, each, offset in packing.plan(counts, 64):
        for k in range(end_rank - first_rank):
            bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert sum(map(len, bins.values())) == sum(counts.values())
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= n or len(bins) == n


def test_pack(docs):
    got = packing.pack(docs).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = [*plain_ids(text), 0]
        want += [(doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048
    assert packing.pack(docs.where("doc_id = 99")).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
    assert (bitfiles.unpacked(bitfiles.packed(ids, bits), bits, len(ids)) == ids).all()


def test_random_access():
    class Kept(io.BytesIO):
        def close(self):
            pass

        def size(self):
            return len(self.getvalue())

    out, draw = Kept(), random.Random(3)
    writer = bitfiles.Writer(out, 13, block=64)
    parts = [np.array([draw.randrange(1 << 13) for _ in range(n)], "<u4") for n in (1, 200, 0, 63, 65, 500)]
    for k, p in enumerate(parts):
        writer.add(None if k == 3 else k, p)
    writer.close()
    reader, flat = bitfiles.Reader(out), np.concatenate(parts)
    assert (reader.ids(10, 700) == flat[10:700]).all() and len(reader.ids(5, 5)) == 0
    assert [x[0] for x in reader.documents()] == [0, 1, 2, None, 4, 5]
    assert [x[3] for x in reader.documents()] == [zlib.crc32(p.tobytes()) for p in parts]


def test_bit_files(spark, docs):
    from mirrorfold.llm.common import scratch

    folder = scratch(spark, "bits")
    shards = bitfiles.write(docs, folder, tokens.default_tokenizer())
    got = sorted(bitfiles.read(spark, folder, shards).collect(), key=lambda r: r["start"])
    want, start = [], 0
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain_ids(text), 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert bitfiles.read(spark, folder, bitfiles.write(docs.where("doc_id = 99"), folder, tokens.default_tokenizer())).count() == 0


def test_lz_prints(spark, docs):
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in lzprint.prints(docs).collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    import hashlib

    for k, (doc_id, text, *_) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        new = lzprint.edited(text, other)
        r = got[doc_id, len(text), hashlib.sha256(new.encode()).hexdigest()]
        mine = lzprint.fingerprint(text)
        assert r["fingerprint"] == lzprint.text_of(mine) and r["edited_fingerprint"] == lzprint.text_of(lzprint.fingerprint(new))
        assert r["near_edited"] == lzprint.likeness(mine, lzprint.fingerprint(new)) and r["near_next"] == lzprint.likeness(mine, lzprint.fingerprint(other))
    assert lzprint.prints(docs.where("doc_id = 99")).count() == 0


def plain_phrases(data):
    """The textbook parse: the shortest run that the dictionary lacks."""
    found, start = [], 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in found:
            found.append(data[start:end])
            start = end
    return found, data[start:]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abé ", max_size=60), st.integers(0, 80))
def test_lz_parse_is_the_textbook_one(text, at):
    data = text.encode()
    want, rest = plain_phrases(data)
    for got in (lzprint.Phrases().parse(data), lzprint.Phrases().parse(data[:at]).copy().parse(data[at:])):
        spelt = {0: b""}
        for step, n in sorted(got.next.items(), key=lambda x: x[1]):
            spelt[n] = spelt[step >> 8] + bytes([step & 255])
        assert [spelt[n] for n in range(1, len(spelt))] == want and spelt[got.open] == rest
        assert len(set(got.hashes)) == len(got.hashes)


def test_lz_work_is_linear():
    import time

    def took(n):
        began = time.process_time()
        lzprint.Phrases().parse(b"a" * n)
        return time.process_time() - began

    took(1000)
    assert took(2_000_000) < 40 * max(took(200_000), 0.01)


def test_lz_likeness_against_sets():
    draw = random.Random(8)
    for _ in range(30):
        a, b = (" ".join(draw.choice(["the", "cat", "sat", "on", "mats", "and", "ran"]) for _ in range(draw.randrange(300))) for _ in "ab")
        prints = [sorted({int(h) for h in lzprint.fingerprint(t)}) for t in (a, b)]
        least = sorted(set(prints[0]) | set(prints[1]))[: lzprint.KEPT]
        want = sum(h in prints[0] and h in prints[1] for h in least) / len(least) if least else 1.0
        assert lzprint.likeness(*(lzprint.fingerprint(t) for t in (a, b))) == want


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href=x>Home</a></ul></nav><div class="sidebar"><p>The side of the page with the many words that you and I know.</p></div>
<article><h1>Head &amp; title</h1><p><b>The first   paragraph
of the text.<br>Goes &eacute; on<p>Short.</p><aside>Not that</aside><form>Send <input></form></article>
<div id="comments"><p>I think that the article is good and it was there for all of us.</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "Head & title\n\nThe first paragraph of the text. Goes é on\n\nShort."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p>") == ""
    loose = "<div class=menu><a href=a>One</a> <a href=b>Two</a></div><h2>Head</h2><p>The quick brown fox is in the house of the king, and it was there for a long time.</p><p>And so on.</p><div class=ad>Buy it</div>"
    assert htmltext.main_text(loose) == "Head\n\nThe quick brown fox is in the house of the king, and it was there for a long time.\n\nAnd so on."


def test_densities_decide_with_an_article_and_without():
    advert = "<p>Pills cheap buy now order casino bonus win cash prizes best price discount offer click order cheap pills</p>"
    text = "<p>The quick brown fox is in the house of the king, and it was there for a long time with all of us.</p>"
    words = "The quick brown fox is in the house of the king, and it was there for a long time with all of us."
    assert htmltext.main_text(f"<article>{advert}</article><div>{text}</div>") == words
    assert htmltext.main_text(f"<div>{text}</div><article class=related>{text}</article><article class='comment'>{text}</article>") == words
    assert htmltext.main_text(f"<article>{advert}{text}</article>").endswith(words) and "Pills" in htmltext.main_text(f"<article>{advert}{text}</article>")
    assert htmltext.main_text(f"<article class='post related-posts'>{text}</article>") == words
    assert "Pills" in htmltext.main_text(f"<article>{advert}</article>") and htmltext.main_text(advert) == ""


def plain_labels(found):
    """The rules over blocks again, block by block."""
    first = []
    for b in found:
        letters = len(b.text.replace(" ", ""))
        w = [x for x in htmltext.WORDS.findall(b.text.lower())]
        share = len([x for x in w if x in htmltext.STOP]) / len(w) if w else 0
        if b.out or (b.linked / max(letters, 1) > 0.4 and (b.linked > 20 or not b.main)):
            first.append("no")
        elif len(b.text) < 70:
            first.append("no" if b.text.startswith("©") and not b.main else "open")
        elif share >= 0.25 or share >= 0.12 and (b.main or len(b.text) >= 200):
            first.append("yes")
        elif b.main or share >= 0.12:
            first.append("open")
        else:
            first.append("open" if len(w) >= 5 and len(b.text) >= 200 else "no")
    final = []
    for k, b in enumerate(found):
        if first[k] != "open":
            final.append(first[k] == "yes")
            continue
        peers = [j for j, o in enumerate(found) if not o.out and first[j] != "open" and (o.main or not b.main)]
        near = [first[j] == "yes" for j in (max((j for j in peers if j < k), default=None), min((j for j in peers if j > k), default=None)) if j is not None]
        after = [first[j] == "yes" for j in peers if j > k][:1]
        final.append(any(near) if b.main else after == [True] if b.heading else bool(near) and all(near))
    return final if any(final) else [b.main and x == "open" for b, x in zip(found, first)]


BLOCK = st.builds(
    lambda words, n, link, *flags: htmltext.Block(t := (" ".join(words) * n)[:260].strip() or "x", int(link * len(t.replace(" ", ""))), *flags),
    st.lists(st.sampled_from(["the", "of", "and", "house", "river", "stone", "©"]), min_size=1, max_size=6), st.integers(1, 12), st.sampled_from([0, 0, 0.3, 0.5, 1.0]), st.booleans(), st.booleans(), st.booleans(),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(BLOCK, max_size=9))
def test_passes_against_plain_rules(found):
    assert htmltext.second_pass(found, [htmltext.first_pass(b) for b in found]) == plain_labels(found)


def test_pages(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2), (2, "v", "<p>" + "the word of it " * 50_000 + "</p>", 3)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long"))
    assert sorted(r["n_chars"] for r in got.collect()) == sorted([len(htmltext.main_text(r[2])) for r in rows])
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
