"""Each operator against brute force, on hostile tables, and on empty ones."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provgraph.llm import bpe, bpe_stream, decontaminate, exact_dedup, kernel, lattice, ngram_join, perspectives, quality, substring_dedup, token_counts, toxicity
from provgraph.llm.components import components

from . import cases

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


def raw(name):
    with open(P.path(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def rows():
    return cases.texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cases.frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nabABé中!", max_size=40), max_size=8), st.integers(1, 40))
def test_words_and_hashes(texts, limit):
    seen = {}
    for i, j, w in kernel.words_of(pa.array(texts, pa.string()), True, limit):
        got = [[] for _ in range(j - i)]
        for k in range(len(w.start)):
            s = w.text(k).decode()
            got[w.row[k]].append(s)
            assert seen.setdefault(s, w.hash[k]) == w.hash[k]
        assert got == [cases.words(cases.lower(t)) for t in texts[i:j]]
    assert len(set(seen.values())) == len(seen)


def test_exact_dedup(spark, rows, docs, empty):
    def answer(group):
        groups = {}
        for i, t in group:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
        return {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}

    for bits, capacity in ((64, 100_000), (3, 2), (64, 3)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, capacity, bits).collect()}
        assert got == answer(rows)
    assert exact_dedup.exact_dedup(empty).count() == 0
    null_id = cases.frame(spark, [(None, "p q"), (1, "pq"), (1, "p  q"), (None, "z"), (None, "z")])
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup.exact_dedup(null_id).collect())
    assert got == [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True)]


def test_drop_copies_decides_by_row(spark):
    """Of copies one row stays, whatever ids repeat or are missing, and no other text is lost."""
    rows = [(1, "same text"), (1, "same text"), (2, "same text"), (2, "a unique text"), (None, "b"), (None, " b"), (None, "c"), (None, "c"), (5, None), (6, "")]
    frame = cases.frame(spark, rows)
    kept = exact_dedup.drop_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, " b"), (-1, "c"), (1, "same text"), (2, "a unique text"), (5, "")]
    assert exact_dedup.drop_copies(frame.limit(0)).count() == 0


def test_directory(spark, monkeypatch):
    """Buckets are the shortest prefixes that are not overfull, cover every hash once, and a wrong slot loses rows."""
    r = np.random.default_rng(2)
    hashes = [int(x) for x in r.integers(-(1 << 63), 1 << 63, 500)] + [(7 << 57) + i for i in range(60)]
    frame = spark.createDataFrame([(h,) for h in hashes], "h long")
    directory, depth = exact_dedup.build_directory(frame, 20, 64)
    top = [(h % (1 << 64)) >> (64 - depth) for h in hashes]
    rows = {x.slot: (x.bucket, x.depth) for x in directory.collect()}
    assert set(rows) == set(top)
    for slot, (bucket, own) in rows.items():
        assert slot >> (depth - own) == bucket >> (depth - own) and bucket % (1 << (depth - own)) == 0
        inside = sum(t >> (depth - own) == slot >> (depth - own) for t in top)
        parent = sum(t >> (depth - own + 1) == slot >> (depth - own + 1) for t in top)
        assert (inside <= 20 or own == depth) and (own == 0 or parent > 20)
    assert len({own for _, own in rows.values()}) > 1
    docs = cases.frame(spark, [(i, f"text {i}") for i in range(300)])
    whole = exact_dedup.exact_dedup(docs, 10).count()
    build = exact_dedup.build_directory
    monkeypatch.setattr(exact_dedup, "build_directory", lambda *given: (lambda d, depth: (d.filter("slot % 2 = 0"), depth))(*build(*given)))
    assert whole == 300 > exact_dedup.exact_dedup(docs, 10).count()


def test_shared_tables_can_be_dropped(spark, docs):
    from provgraph.llm import shared

    shared.drop_stored(spark)
    kept = shared.stored(docs, "x")
    assert kept.count() == docs.count() and shared.drop_stored(spark) == 1
    with pytest.raises(Exception, match="(?i)path|file"):
        kept.count()


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (10, 11), (12, 12), (5, 4), (4, 6), (6, 5)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.vid: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 4: 4, 5: 4, 6: 4} | dict.fromkeys(range(100, 131), 100)


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = cases.texts(seed, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(cases.frame(spark, rows)).collect()}
    want = cases.near_groups(rows)
    assert got == {i: (len(cases.shingles(t)), want[i]) for i, t in rows}
    assert len(set(want.values())) < len(rows)


def test_ngram_join_cases(spark, empty):
    assert ngram_join.near_components(empty).count() == 0
    other = " ".join(f"w{i}" for i in range(30))
    frame = cases.frame(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (8, None), (7, other), (9, other + " z"), (None, "p q"), (None, "")])
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.near_components(frame).collect())
    assert got == [(-1, 0, -1), (-1, 1, -1), (-1, 2, 3), (3, 2, 3), (7, 2, 3), (7, 2, 3), (7, 26, 7), (8, 0, 8), (9, 27, 7)]
    kept = ngram_join.drop_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, ""), (-1, "p q"), (3, "A b c d e f"), (7, other), (8, "")]
    assert ngram_join.drop_near_copies(frame.limit(0)).count() == 0


def test_ngram_join_of_a_clause_library(spark, monkeypatch):
    """Texts of half of 40 clauses meet everywhere and never link: few pairs may leave a column; those that do link are found."""
    r = np.random.default_rng(8)
    clauses = [" ".join(f"c{i}w{j}" for j in range(12)) for i in range(40)]
    rows = [(i, " ".join(clauses[c] for c in sorted(r.choice(40, 20, replace=False)))) for i in range(400)]
    rows += [(400 + i, t + f" tail{i}") for i, (_, t) in enumerate(rows[:20])]
    counted, take = [], ngram_join.remaining_pairs
    monkeypatch.setattr(ngram_join, "remaining_pairs", lambda *given: (lambda p: counted.append(p.count()) or p)(take(*given)))
    got = {x.doc_id: x.component_id for x in ngram_join.near_components(cases.frame(spark, rows)).collect()}
    assert got == cases.near_groups(rows)
    assert sum(counted) < 400, counted


def test_near_copies_without_all_pairs(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for j in range(i % 3):
            own[(i * 7 + j * 31) % 120] = f"new{i}x{j}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(cases.frame(spark, rows)).collect()}
    assert got == cases.near_groups(rows)


def test_token_counts(docs, rows, empty):
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, raw("byte_bpe_50k.json"), limit=100).collect()}
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert got == {i: (len((t or "").encode()), want[i], want[i] > 100) for i, t in rows}
    assert token_counts.count_tokens(empty, raw("byte_bpe_50k.json")).count() == 0


def test_whole_tokens_are_proved():
    table = bpe.MergeTable(raw("byte_bpe_50k.json"))
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole = sorted(token_counts.prove_whole_tokens(table))
    assert len(whole) > 40_000
    for s in whole[::97]:
        if token_counts.regex.fullmatch(token_counts.PRE_TOKENS, s):
            assert len(lib.encode(s, add_special_tokens=False).ids) == 1


def test_long_pre_tokens_are_counted_in_windows():
    table = bpe.MergeTable(raw("byte_bpe_50k.json"))
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counter = token_counts.Counter(table, frozenset())
    r = np.random.default_rng(5)
    for text in ("ha" * 20_000, "".join(r.choice(list("hainothe"), 40_000)), "=" * 30_000, "中文" * 9_000):
        assert counter.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


HARD = st.text(alphabet="aAbthehinon 's\n\t \x1c\x85Σİéé中٣Ⅷ!#$😀", max_size=120)


@settings(max_examples=150, deadline=None)
@given(HARD)
def test_counting_and_encoding_match_the_library(text):
    if not hasattr(test_counting_and_encoding_match_the_library, "kit"):
        a, b = bpe.MergeTable(raw("byte_bpe_50k.json")), bpe.MergeTable(raw("word_bpe_49k.json"))
        test_counting_and_encoding_match_the_library.kit = (
            token_counts.Counter(a, token_counts.prove_whole_tokens(a)),
            tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")),
            bpe_stream.Transcoder(b, bpe_stream.sufficient_lookahead(b)),
            tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")),
        )
    counter, lib_a, coder, lib_b = test_counting_and_encoding_match_the_library.kit
    assert counter.count(text) == len(lib_a.encode(text, add_special_tokens=False).ids)
    ids = coder.encode(text)
    assert ids == lib_b.encode(text, add_special_tokens=False).ids
    assert coder.names(ids) == lib_b.decode(ids, skip_special_tokens=False)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="hainotesr", min_size=1500, max_size=6000), st.integers(1, 700))
def test_streaming_equals_whole(word, piece):
    table = bpe.MergeTable(raw("word_bpe_49k.json"))
    stream = bpe_stream.StreamEncoder(table, bpe_stream.sufficient_lookahead(table))
    data, out = word.encode(), []
    for i in range(0, len(data), piece):
        out += stream.feed(data[i : i + piece])
        assert len(stream.held) <= stream.window
    out += stream.finish()
    assert out == table.merge(table.symbols(data))
    assert bpe_stream.Transcoder(table, stream.lookahead).decode(out) == word + " "


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAsReé́中가ᅡᆨ' \n!#Σ1", max_size=60), st.integers(4, 12))
def test_blocks_cut_within_words_change_nothing(text, block):
    if not hasattr(test_blocks_cut_within_words_change_nothing, "kit"):
        table = bpe.MergeTable(raw("word_bpe_49k.json"))
        test_blocks_cut_within_words_change_nothing.kit = bpe_stream.Transcoder(table, bpe_stream.sufficient_lookahead(table)), tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    coder, lib = test_blocks_cut_within_words_change_nothing.kit
    before, bpe_stream.BLOCK = bpe_stream.BLOCK, block
    try:
        ids = coder.encode(text)
    finally:
        bpe_stream.BLOCK = before
    assert ids == lib.encode(text, add_special_tokens=False).ids


def test_every_text_goes_through_encoder_and_decoder(monkeypatch):
    """Encoder and decoder are made for every text, and each new word is fed to them; a huge word needs a window only."""
    table = bpe.MergeTable(raw("word_bpe_49k.json"))
    coder = bpe_stream.Transcoder(table, bpe_stream.sufficient_lookahead(table))
    made, held, fed = Counter(), [0], [0]
    for kind in (bpe_stream.StreamEncoder, bpe_stream.StreamDecoder):

        def init(self, *given, kind=kind, was=kind.__init__):
            made[kind.__name__] += 1
            was(self, *given)

        monkeypatch.setattr(kind, "__init__", init)
    stable, text = bpe_stream.StreamEncoder._stable, bpe_stream.StreamDecoder.text
    monkeypatch.setattr(bpe_stream.StreamEncoder, "_stable", lambda self: held.append(len(self.held)) or stable(self))
    monkeypatch.setattr(bpe_stream.StreamDecoder, "text", lambda self, ids: fed.append(len(ids)) or text(self, ids))
    texts = ["one two", "", "two", "ha" * 500_000]
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        before = Counter(made)
        n, names, running, most = 0, hashlib.sha256(), [], 0
        for own, (a, b) in coder.transcoded(t, (3, 4)):
            n, most = n + own, max(most, own)
            names.update(a)
            running.append(b)
        ids = lib.encode(t, add_special_tokens=False).ids
        assert n == len(ids) and names.hexdigest() == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert b"".join(running).decode() == "".join(w + " " for w in t.split())
        assert most <= 4096
        assert all(made[k] > before[k] for k in ("StreamEncoder", "StreamDecoder")), i
    assert max(held) <= 2 * coder.window and sum(fed) > 50_000


def test_transcode(docs, rows, empty):
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    vocab = raw("word_bpe_49k.json")
    full = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded) for r in bpe_stream.transcode(docs, vocab).collect()}
    running = {r.doc_id: r.decoded for r in bpe_stream.transcode(docs, vocab, running=True).collect()}
    digest = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.running_sha256) for r in bpe_stream.transcode(docs, vocab, digest=True).collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert full[i] == (len(ids), ids, text)
        assert digest[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(running[i].encode()).hexdigest())
    assert bpe_stream.transcode(empty, vocab).count() == 0


def test_decontaminate(spark, rows, docs, empty, monkeypatch):
    r = np.random.default_rng(3)
    items = [(0, None), (1, "")]
    for k, (_, t) in enumerate(rows):
        w = cases.words(t)
        if len(w) > 14:
            a = int(r.integers(0, len(w) - 14))
            part = w[a : a + 14]
            if k % 2:
                part[int(r.integers(0, 14))] = "other"
            items.append((k + 10, " ".join(part)))
    items.append((500, "one two"))
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = set()
    for i, t in items:
        own = cases.shingles(t)
        for d, text in rows:
            shared = len(own & cases.shingles(text))
            if own and 10 * shared >= 8 * len(own):
                want.add((d, i, len(own), shared))
    got = decontaminate.find_items(docs, frame)
    assert {(x.doc_id, x.item_id, x.item_shingles, x.shared) for x in got.collect()} == want and want
    kept = decontaminate.drop_contaminated(docs, frame)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {d for d, _ in rows} - {w[0] for w in want}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert {(x.doc_id, x.item_id, x.item_shingles, x.shared) for x in decontaminate.find_items(docs, frame).collect()} == want
    assert decontaminate.find_items(empty, frame).count() == 0
    assert decontaminate.find_items(docs, frame.limit(0)).count() == 0
    assert decontaminate.contaminated_summary(got).count() == len({w[0] for w in want})


def test_index_of_items_is_small():
    """What travels is a few times the items' text."""
    import pickle

    r = np.random.default_rng(6)
    items = [(i, " ".join(f"word{x}" for x in r.integers(0, 5000, 60))) for i in range(2000)]
    index = decontaminate.build_index(items, 0.8, 5)
    assert len(pickle.dumps(index, 5)) < 6 * sum(len(t) for _, t in items)
    for i, _, words in kernel.words_of(pa.array([items[7][1], "no", items[9][1] + " tail", None], pa.string()), True):
        assert [(i + r, index.ids[item]) for r, item, _ in decontaminate.search(index, words)] == [(0, 7), (2, 9)]


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_substring_dedup(docs, rows, batches, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUFFER_ROWS", 50)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_substrings(docs, batches=batches).collect()}
    want = cases.cut_words(rows)
    assert got == want and any(n for _, n, _ in want.values())


def test_substring_query_merges_a_batch_with_compacted_runs(spark, monkeypatch):
    from provgraph.llm.queries import op10_substring_dedup

    from .test_entry import SF

    merged, add = [], substring_dedup.SubstringIndex.add

    def noted(self, *given):
        merged.append([run.rsplit("/", 1)[1].split("-")[0] for run in self.runs])
        return add(self, *given)

    monkeypatch.setattr(substring_dedup.SubstringIndex, "add", noted)
    assert op10_substring_dedup(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert ["compact"] in merged


def test_substring_dedup_cases(spark, empty):
    assert substring_dedup.dedup_substrings(empty).count() == 0
    w = " ".join(f"w{i}" for i in range(25))
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(cases.frame(spark, [(None, w), (5, w), (5, w), (4, None)])).collect())
    assert got == [(4, 0, 0), (5, 25, 0), (5, 25, 25), (99, 25, 25)]
    rows = [(None, f"{w} own{i}") for i in range(6)] + [(None, None), (1 << 61, "a b")]
    assert sorted(r.n_removed for r in substring_dedup.dedup_substrings(cases.frame(spark, rows), batches=2).collect()) == [0, 0, 0] + [25] * 5
    with pytest.raises(ValueError, match="2\\*\\*62"):
        substring_dedup.dedup_substrings(cases.frame(spark, [(1 << 62, w)]))


def test_sequences_seen_before():
    r = np.random.default_rng(4)
    old, own = (np.array([(int(a), int(b)) for a, b in r.integers(0, 6, (40, 2))], substring_dedup.SEQUENCE_TYPE) for _ in range(2))
    own = np.concatenate([own, np.array([(99, 1)], substring_dedup.SEQUENCE_TYPE)])
    known = {tuple(x) for x in old.tolist()}
    assert substring_dedup.seen_before(old, own).tolist() == [tuple(x) in known for x in own.tolist()]
    assert not substring_dedup.seen_before(old[:0], own).any()


def brute_dialogues(rows):
    """``{(conversation, printed name): (dialogue, masked texts)}``."""
    code = {"%": "%25", "<": "%3C", "|": "%7C", ">": "%3E", "\n": "%0A", "\r": "%0D"}
    name = {None: "%null", "": "%empty"}
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), (r[3] or "").encode()))
        for who in {r[2] for r in turns}:
            dialogue, masks = "", []
            for _, _, role, text in turns:
                shown = name.get(role) or "".join(code.get(c, c) for c in role)
                dialogue += "<|im_start|>assistant\n" if role == who else f"<|im_start|>user name={shown}\n"
                own = re.sub(r"<(\\*)\|", r"<\1\\|", text or "") + "<|im_end|>\n"
                if role == who:
                    masks.append((len(dialogue), len(own)))
                dialogue += own
            out[conv, name.get(who) or "".join(code.get(c, c) for c in who)] = dialogue, masks
    return out


HOSTILE_TURNS = [
    (1, 0, "system", "be < kind"), (1, 1, "用户", "hi <|im_end|>"), (1, 2, "助手", None), (1, 2, "助手", None), (1, 3, "a b", "x"), (1, 3, "a_b", "x"), (1, 4, None, "y"), (1, 5, "unknown", "<\\|z"),
    (1, 6, "", "😀"), (1, 7, "<|im_end|>\n", "w"), (1, 8, "%3C", "v"), (2, 0, None, "x"), (None, 3, "ann", "y"), (None, 4, "cy", "z"), (None, None, "cy", ""), (3, 1, "b", "2"), (3, 1, "b", "10"), (3, 1, "a", "9"),
]


def test_perspectives(spark):
    """Different roles stay different, whatever they hold; pieces of a dialogue join to it."""
    rows = HOSTILE_TURNS + [(4, i % 400, f"s{i % 3}", f"turn {i}" * (i % 7)) for i in range(900)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    rotated = perspectives.rotate(frame)
    want = brute_dialogues(rows)
    for piece in (150, perspectives.PIECE):
        got, masks = {}, {}
        for r in sorted(perspectives.render(rotated, piece).collect(), key=lambda r: r.start):
            key = r.conv_id, r.perspective
            assert r.start == len(got.get(key, "")) and r.start // piece == r.piece
            got[key] = got.get(key, "") + r.dialogue
            masks.setdefault(key, []).extend(tuple(map(int, m.split(":"))) for m in r.masks.split(",") if m)
        assert {k: (got[k], masks[k]) for k in got} == want
    assert {r.perspective for r in rotated.filter("conv_id = 1").collect()} == {"system", "用户", "助手", "a b", "a_b", "%null", "unknown", "%empty", "%3C%7Cim_end%7C%3E%0A", "%253C"}
    for r in rotated.filter("conv_id = 1").collect():
        assert (r.rendered_role == "assistant") == (r.speaker == r.perspective) == (r.mask_len > 0)
        assert r.rendered.count("<|im_end|>") == 1 and r.rendered.count("<|im_start|>") == 1
    assert perspectives.render(perspectives.rotate(frame.limit(0))).count() == 0


def test_escaped_texts_can_be_restored(spark):
    texts = ["<|", "<\\|", "<\\\\|", "a<|b<\\|c\\<||", "<<||", "", "no"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = frame.select("text", perspectives.escaped(F.col("text")).alias("e")).select("text", "e", perspectives.restored(F.col("e")).alias("back")).collect()
    assert all(r.back == r.text and "<|" not in r.e for r in got) and len({r.e for r in got}) == len(texts)


def brute_lattice(word, p):
    total = np.zeros(len(word) + 1, np.longdouble)
    total[0] = 1
    for j in range(1, len(word) + 1):
        for i in range(j):
            total[j] += total[i] * p.get(word[i:j], 0.0)
    return total[-1]


def test_lattice_sums_all_segmentations():
    p = {bytes([b]): 0.001 for b in range(256)} | {b" a": 0.2, b"ab": 0.1, b" ab": 0.05, b"ba": 0.1, b"abab": 0.02, "é".encode(): 0.01}
    table = lattice.Table(list(p))
    own = lattice.Lattice(table, np.log(np.array(list(p.values()))))
    for word in ("a", "abab", "bababa", "éab", "zzz", "ab" * 30):
        data = np.frombuffer(b" " + word.encode(), np.uint8)[None, :]
        want = math.log(brute_lattice(b" " + word.encode(), p))
        assert own.log_likelihood(data)[0] == pytest.approx(want)
        assert own.long_word(b" " + word.encode()) == pytest.approx(want)
    into = np.zeros(len(p))
    own.expected(np.frombuffer(b" abab", np.uint8)[None, :], np.array([3.0]), into)
    spent = sum(n * len(w) for n, w in zip(into, p, strict=True))
    assert spent == pytest.approx(3 * 5)


@pytest.mark.parametrize("stretch", [7, 64, 4096])
def test_lattice_long_words_are_expected(monkeypatch, stretch):
    monkeypatch.setattr(lattice, "STRETCH", stretch)
    p = {bytes([b]): 0.001 for b in range(256)} | {b" a": 0.2, b"ab": 0.1, b" ab": 0.05, b"ba": 0.1, b"abab": 0.02, "中".encode(): 0.01}
    own = lattice.Lattice(lattice.Table(list(p)), np.log(np.array(list(p.values()))))
    for word in ("a", "ab" * 64, "中ab" * 25 + "zz"):
        marked = b" " + word.encode()
        want, got = np.zeros(len(p)), np.zeros(len(p))
        own.expected(np.frombuffer(marked, np.uint8)[None, :], np.ones(1), want)
        own.expected_long(marked, 1.0, got)
        assert got == pytest.approx(want)
    got = np.zeros(len(p))
    own.expected_long(b" " + "ab中".encode() * 2000, 1.0, got)
    assert sum(n * len(w) for n, w in zip(got, p, strict=True)) == pytest.approx(10_001)


def test_lattice_learns_from_long_words(spark):
    """Every training word counts in the E-step: the expected pieces cover all its bytes."""
    texts = [(0, "中文" * 40), (1, "x" * 1000), (2, "ab cd")]
    p = lattice.first_weights(lattice.read_pieces(P.path("piece_bpe_32k.model")))
    source = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "false held")
    words = lattice.word_table(lattice.deal(lattice.word_counts(source, 1), 1))
    found = lattice.expectation(words, lattice.Table(list(p)), np.log(np.array(list(p.values()))))
    assert sum(n * len(w) for n, w in zip(found, p, strict=True)) == pytest.approx(sum(1 + len(w.encode()) for _, t in texts for w in t.split()))


@pytest.mark.parametrize("head", [0, 1 << 19])
def test_lattice_documents(spark, docs, rows, head):
    got = {r.doc_id: r for r in lattice.score_documents(docs, P.path("piece_bpe_32k.model"), head=head).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    count, n_docs = Counter(), 0
    for i, t in rows:
        if not held[i]:
            count.update(cases.words(cases.lower(t or "")))
            n_docs += 1
    n, v = sum(count.values()) + n_docs, len(count) + 1
    for i, t in rows:
        w = cases.words(cases.lower(t or ""))
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((n_docs + 0.5) / (n + 0.5 * (v + 1)))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
        assert r.base_score == pytest.approx(base) and r.score < 0


def brute_weights(counts, n_docs, first, rounds, prior):
    """Expected pieces by forward and backward sums, word by word, in plain numbers."""
    p, end = dict(first), 0.5
    longest = max(map(len, first))
    for _ in range(rounds):
        found = dict.fromkeys(p, 0.0)
        for w, c in counts.items():
            marked = b" " + w.encode()
            size = len(marked)
            arcs = [(i, j) for i in range(size) for j in range(i + 1, min(size, i + longest) + 1) if marked[i:j] in p]
            ahead, back = np.zeros(size + 1, np.longdouble), np.zeros(size + 1, np.longdouble)  # long words have tiny sums
            ahead[0] = back[-1] = 1
            for i, j in sorted(arcs, key=lambda a: a[1]):
                ahead[j] += ahead[i] * p[marked[i:j]]
            for i, j in sorted(arcs, key=lambda a: -a[0]):
                back[i] += p[marked[i:j]] * back[j]
            for i, j in arcs:
                found[marked[i:j]] += c * ahead[i] * p[marked[i:j]] * back[j] / ahead[-1]
        total = sum(found.values())
        p = {x: (1 - prior) * found[x] / total + prior * first[x] for x in p}
        end = n_docs / (total + n_docs)
    return {x: y * (1 - end) for x, y in p.items()}, end


@pytest.mark.parametrize("prior", [0.2, 1.0])
def test_lattice_scores_whole_documents(spark, prior):
    """Every document's score is the brute-force sum over all segmentations under brute-force weights."""
    rows = [(i, t) for i, t in cases.texts(3, 40) if len(t or "") < 1000] + [(None, "null id trains"), (7, "ring ring Table"), (90, "zz" * 120 + " ring")]
    got = lattice.score_documents(cases.frame(spark, rows), P.path("piece_bpe_32k.model"), prior=prior)
    count, n_docs = Counter(), 0
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(cases.words(cases.lower(t or "")))
            n_docs += 1
    p, end = brute_weights(count, n_docs, lattice.first_weights(lattice.read_pieces(P.path("piece_bpe_32k.model"))), lattice.ROUNDS, prior)
    want = [(i if i is not None else -1, math.log10(end) + sum(float(np.log10(brute_lattice(b" " + w.encode(), p))) for w in cases.words(cases.lower(t or "")))) for i, t in rows]
    have = [(r.doc_id if r.doc_id is not None else -1, r.score) for r in got.collect()]
    assert [i for i, _ in sorted(have)] == [i for i, _ in sorted(want)]
    assert [x for _, x in sorted(have)] == pytest.approx([x for _, x in sorted(want)])


def test_lattice_is_a_distribution(spark):
    """Over one-word texts of two letters, probabilities sum to less than one."""
    letters = "abcdefgh"
    rows = [(i, t) for i, t in enumerate([a + b for a in letters for b in letters] + ["ab ab ab cd", "ab"])]
    got = lattice.score_documents(cases.frame(spark, rows), P.path("piece_bpe_32k.model")).filter("doc_id < 64").collect()
    assert 0 < sum(10**r.score for r in got) < 1


def test_lattice_empty(empty):
    assert lattice.score_documents(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_classifiers_learn(spark):
    from .test_entry import SF

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.classify_quality(docs, labels).join(labels, "doc_id")
    good = scored.groupBy("quality").avg("score").collect()
    means = {r.quality: r["avg(score)"] for r in good}
    assert means[1] > means[0] + 0.3
    held = scored.filter("held_out").selectExpr("avg(cast(predicted = quality as int)) a").first().a
    assert held > 0.8


def test_classifier_cases(spark, docs, empty, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify_quality(docs, none).collect()} == {0.5}
    model = toxicity.train(docs, none)
    assert {(r.score, r.rejected) for r in toxicity.score(docs, model).collect()} == {(0.0, False)}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in rows] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify_quality(docs, labels).count() == len(rows)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0 and quality.classify_quality(empty, labels).count() == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)


@pytest.mark.parametrize("name", ["op5_quality", "op6_toxicity"])
def test_held_out_labels_teach_nothing(spark, name, tmp_path):
    """Flipping the labels of held-out rows leaves every score as it was; held-out accuracy is good."""
    from provgraph.llm.queries import QUERIES

    from .test_entry import SF

    label, modulus, rest = {"op5_quality": ("quality", 3, 1), "op6_toxicity": ("toxic", 4, 2)}[name]
    held = f"crc32(cast(cast(doc_id as string) as binary)) % {modulus} = {rest}"
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.selectExpr("doc_id", *(f"if({held} and '{c}' = '{label}', 1 - {c}, {c}) {c}" for c in ("quality", "toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    one, two = ({r.doc_id: (r.held_out, round(r.score, 12)) for r in QUERIES[name](spark, str(d)).collect()} for d in (SF, tmp_path))
    assert one == two
    assert {i for i, (h, _) in one.items() if h} == {i for i in one if zlib.crc32(str(i).encode()) % modulus == rest}


def test_quality_scores_are_dot_products(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    w = quality.train(docs, labels, "quality", 3, 1)
    got = {r.doc_id: r.score for r in quality.score(docs, w, 3, 1).collect()}
    for i, t in rows:
        at = [int(f) for _, _, f, _ in quality.features(pa.array([t], pa.string())) for f in f]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(sum(float(w[f]) for f in at) / math.sqrt(max(1, len(at))) + float(w[-1])))))


def test_training_sample_is_bounded(spark):
    """Rows that repeat an id count once, and no more bytes are read than stated."""
    from provgraph.llm import labelled

    rows = [(i, i % 2, "en", bytes([i]) * 10) for i in range(20)] + [(3, 1, "en", b"z" * 10)] * 5
    frame = spark.createDataFrame(rows, "doc_id long, label int, lang string, x binary")
    assert sorted(x for _, _, x in labelled.learned(frame, list)) == sorted(bytes([i]) * 10 for i in range(20))
    assert len(labelled.learned(frame, list, 55)) == 5
    assert labelled.learned(frame.limit(0), list) == []


def test_toxicity_learns_from_every_labelled_row(spark, tmp_path):
    """A word whose labelled rows all come late in the order of the ids' hash is learnt like any other."""
    from provgraph.llm.queries import QUERIES

    cases.late_word(spark, str(tmp_path))
    got = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, str(tmp_path)).collect()}
    assert got[-1].score > 0.9 and got[-2].score < 0.1


def test_toxicity_shards_hold_every_labelled_row(spark, docs, rows):
    """Each labelled row that isn't held out once, whatever repeats, with its label and its own words."""
    more = [(4, "another text of an id"), (4, "another text of an id"), (None, "no id")]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(4, 1), (None, 1), (10**6, 1)], "doc_id long, label int")
    own = toxicity.known(labels, "label", 4, 2)
    source = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("doc_id", "coalesce(text, '') text", "'en' lang")
    texts, n = toxicity.labelled_texts(source, own, 4, 2, 4000)
    assert n > 3
    want = {(i, t or "") for i, t in [*rows, *more] if i is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    want = sorted((1 if i == 4 else i % 2, toxicity.packed(b, w)) for i, t in want for _, _, b, w, _ in toxicity.token_ids(pa.array([t])))

    def plain(label, x):
        buckets, word = toxicity.unpacked(x)
        return label, buckets[word].tobytes()

    parts = [list(toxicity.shards(iter(texts.toArrow().to_batches()), aside)) for aside in (False, True)]
    got = [x for part in parts for _, shard in part for x in shard]
    assert sorted(plain(*x) for x in got) == sorted(plain(*x) for x in want)
    assert 0 < sum(len(s) for _, s in parts[1]) < len(want) / 3 and len({b for b, _ in parts[0]}) > 2


def test_toxicity_round_is_the_weighted_mean_of_shards(spark, docs, rows):
    labels = spark.createDataFrame([(i, int("river" in (t or ""))) for i, t in rows], "doc_id long, label int")
    source = docs.selectExpr("doc_id", "coalesce(text, '') text", "'en' lang")
    texts, n = toxicity.labelled_texts(source, toxicity.known(labels, "label", 4, 2), 4, 2, 4000)
    lines, grown = toxicity.Cnn.fresh().lines(), toxicity.untouched().lines()
    assert (toxicity.Cnn.of(lines).lines() == lines).all()
    moves = []
    for _, shard in toxicity.shards(iter(texts.toArrow().to_batches()), aside=False):
        net, own = toxicity.Cnn.of(lines), toxicity.Cnn.of(grown)
        toxicity.fit(shard, 2, seed=5, net=net, grown=own)
        moves.append((net.lines() - lines.astype(float), own.lines() - grown.astype(float)))
    assert n > 3 and len(moves) > 2
    base = sum(g for _, g in moves)
    want = lines + sum(m * g for m, g in moves) / np.where(base > 0, base, 1)
    got, sums = toxicity.trained_round(texts, lines, grown, 2, 5)
    assert np.allclose(got, want, atol=1e-6) and (got != lines).any()
    assert np.allclose(sums, grown + sum(g * g for _, g in moves) / np.where(base > 0, base, 1), rtol=1e-4)


def test_toxicity_of_many_shards_learns(spark, tmp_path):
    cases.late_word(spark, str(tmp_path))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels, shard_bytes=100_000)
    held = toxicity.score(docs.repartition(3), model).filter("held_out").join(labels, "doc_id").selectExpr("avg(cast(predicted = toxic as int)) a").first().a
    assert held > 0.95 and 0 < model.overall < 1 and model.by_language
    again = toxicity.train(docs.repartition(5), labels.repartition(2), shard_bytes=100_000)
    assert (model.scorer.embed == again.scorer.embed).all() and model.overall == again.overall and model.by_language == again.by_language


def test_ftrl_and_cnn_learn():
    model, r = quality.Ftrl(64), np.random.default_rng(1)
    rows = [(int(k % 2), np.unique(np.append(r.integers(2, 64, 8), k % 2))) for k in range(400)]
    for y, at in rows:
        model.learn(at, y)
    w = model.weights(slice(None))
    assert np.mean([((w[at].sum() / np.sqrt(len(at)) + w[-1]) > 0) == y for y, at in rows]) > 0.95
    examples = []
    for k in range(300):
        ids = r.integers(10, 5000, (int(r.integers(1, 60)), toxicity.FEATURES)).astype(np.uint32)
        if k % 2:
            ids[int(r.integers(0, len(ids)))] = 7
        examples.append((k % 2, toxicity.packed(ids, np.arange(len(ids)))))
    net = toxicity.fit(examples, epochs=6)
    assert np.mean([(net.forward(*toxicity.unpacked(x))[0] > 0) == y for y, x in examples]) > 0.95


def test_scorer_equals_network():
    net = toxicity.Cnn.fresh()
    texts = pa.array(["a", "", "one two three four", None, "x!! y" * 20], pa.string())
    for i, j, buckets, word, row in toxicity.token_ids(texts):
        got = toxicity.Scorer(net).logits(buckets, word, row, j - i)
        for k in range(j - i):
            assert got[k] == pytest.approx(net.forward(buckets, word[row == k])[0], rel=1e-3, abs=1e-4)


def test_thresholds():
    p, y = np.array([0.9, 0.8, 0.4, 0.1]), np.array([1, 1, 0, 0])
    assert 0.4 < toxicity.best_threshold(p, y, np.ones(4)) < 0.8


def test_thresholds_do_not_cut_equal_scores():
    p, y = np.array([0.9, 0.6, 0.6, 0.6, 0.1]), np.array([1, 1, 0, 0, 0])
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0]):
        assert 0.6 < toxicity.best_threshold(p[order], y[order], np.ones(5)) < 0.9
