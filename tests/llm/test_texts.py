"""Fill-in-middle, conversation repair and word BPE: brute force, the library, SQL and edge cases."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinweave.llm import conversation_repair as cr
from twinweave.llm import fill_middle as fm
from twinweave.llm import word_bpe as wb

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
TEXTS = [
    (1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, ""), (4, None), (None, "no id at all"), (5, "has <P> inside"), (6, "naïve ünïcödé 中文 🙂 text"),
    (7, "x"), (7, "x"), (8, " \n\t"), (9, "The CAFÉ's 12 don't <|endoftext|> stop <|startoftext|>"), (10, "lorem ipsum dolor " * 40_000), (11, "q" * 3000),
]


@pytest.fixture(scope="module")
def texts(spark):
    many = [(100 + k, f"row {k} of many words é {k * 7}") for k in range(60)]
    return spark.createDataFrame([(i, t, "a", 0, b"x") for i, t in TEXTS + many], "doc_id long, text string, form string, uid int, refs binary").repartition(3).cache()


def all_texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# fill in middle


def rearranged(doc_id, text):
    d = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [3, 16_384])
def test_middles_equal_brute_force(spark, texts, chunk, monkeypatch):
    monkeypatch.setattr(fm, "CHUNK_UNITS", chunk)
    docs = texts.filter("doc_id is null or doc_id <> 10") if chunk == 3 else texts
    want = Counter((i, *rearranged(i, t)) for i, t in all_texts(docs))
    assert Counter(tuple(r) for r in fm.fill_in_middle(docs).collect()) == want
    digests = Counter((i, *x[:4], sha(x[4]), sha(t)) for i, t in all_texts(docs) for x in [rearranged(i, t)])
    assert Counter(tuple(r) for r in fm.fill_in_middle_digests(docs).collect()) == digests
    assert {x[2] for x in want} == {"plain", "psm", "spm"}


def test_outputs_restore(texts):
    assert Counter(tuple(r) for r in fm.restore(fm.fill_in_middle(texts)).collect()) == Counter(all_texts(texts))


def test_restoring_sorts_without_a_second_shuffle(texts):
    rdd = fm.fill_in_middle_digests(texts).rdd
    assert rdd.toDebugString().decode().count("ShuffledRDD") == 1


def test_middles_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fm.fill_in_middle_digests(none).count() == fm.restore(fm.fill_in_middle(none)).count() == 0


# conversation repair


def least_audit(codes):
    """All edits of short conversations, by breadth: the least (cost, audit)."""
    best = None
    todo = [(0, 0, 0, "")]
    while todo:
        at, state, cost, audit = todo.pop()
        if best and cost > best[0]:
            continue
        if at == len(codes) and state in (0, 3):
            best = min(best or (cost, audit), (cost, audit))
        wanted = "a" if state == 2 else "u"
        after = {"s": 1, "u": 2, "a": 3}
        if not audit.endswith("II") and len(audit) < 2 * len(codes) + 3:
            todo.append((at, after[wanted], cost + 3, audit + "I"))
        if at < len(codes):
            initial, fault = "sua?"[codes[at] >> 2], codes[at] & 3
            todo.append((at + 1, state, cost + 4, audit + "D"))
            if fault < 2:
                extra = 3 * (fault == 1)
                todo.append((at + 1, after[wanted], cost + 3 + extra, audit + "R"))
                if initial == wanted or (initial == "s" and state == 0):
                    todo.append((at + 1, after[initial], cost + extra, audit + "K"))
    return best


def test_audits_equal_all_edits():
    for n in range(3):
        for codes in itertools.product(range(16), repeat=n):
            assert cr.cheapest_audit(bytes(codes)) == least_audit(codes), codes
    draw = random.Random(5)
    for _ in range(250):
        codes = [draw.choice([0, 4, 8, 4, 8, 5, 9, 6, 7, 12]) for _ in range(draw.randrange(3, 7))]
        assert cr.cheapest_audit(bytes(codes)) == least_audit(codes), codes


def test_audits_of_long_conversations_equal_the_forward_table():
    """With a table of the least (cost, audit) of each state after each row."""
    draw = random.Random(6)
    for n in (50, 333):
        codes = [draw.randrange(16) for _ in range(n)]
        table = {0: (0, "")}
        for code in codes:
            after = {}
            for s, (cost, audit) in table.items():
                for t, (c, edits) in cr._MOVES[code][s].items():
                    after[t] = min(after.get(t, (1 << 60, "")), (cost + c, audit + edits))
            table = after
        want = min((c + cr._END[s], a + cr._TAIL[s]) for s, (c, a) in table.items())
        assert cr.cheapest_audit(bytes(codes)) == want


def brute_repair(rows):
    """Faults, audit and lines of one conversation given as (turn, role, text) in order."""
    visible = lambda t: t.strip(cr.SPACES)
    seen, codes, faults = set(), [], Counter()
    for _, role, text in rows:
        fault = 2 if not visible(text) else 3 if (role, text) in seen else 0 if visible(text)[-1] in ".!?" else 1
        seen.add((role, text))
        faults[fault] += 1
        codes.append(4 * ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + fault)
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cr.cheapest_audit(bytes(codes))
    lines, k, state = [], 0, 0
    for e in audit:
        wanted = cr._WANTED[state]
        if e != "I":
            _, role, text = rows[k]
            k += 1
        if e == "D":
            continue
        role, text = (role, text) if e == "K" else (wanted, text) if e == "R" else (wanted, "")
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        lines.append(f"{role}:{text}")
    return gaps, faults[2], faults[3], faults[1], illegal, cost, audit, lines


def talk_rows():
    draw = random.Random(9)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(draw.randrange(1, 9)):
            text = draw.choice(["Yes.", "No!", "cut off", "", " \n ", None, f"Line {turn}?", "Why? \n"])
            rows.append((conv, draw.choice([turn, turn, turn + 1, None]) if draw.random() < 0.1 else turn, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return rows + rows[:6] + [(500, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(3000)]


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in talk_rows()], "conv_id long, turn long, role string, text string, audit string, c int").repartition(4).cache()


def test_repairs_equal_brute_force(talks):
    order = talks.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = order.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(12), "text", "role"))
    by = {}
    for r in sorted(order.collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.role, r.h1, r.h2)):
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = {c: brute_repair(rows) for c, rows in by.items()}
    audits = cr.conversation_audits(talks).cache()
    assert {r.conv_id: tuple(r)[1:] for r in audits.collect()} == {c: w[:-1] for c, w in want.items()}
    assert {r.conv_id: r.repaired_sha256 for r in cr.repaired_digests(talks, audits).collect()} == {c: sha("\n".join(w[-1])) for c, w in want.items()}
    got = {}
    for r in sorted(cr.repaired(talks, audits).collect(), key=lambda r: r.place):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert got == {c: w[-1] for c, w in want.items() if w[-1]}


def test_damage_is_by_the_checksum_of_the_place(talks):
    want = Counter()
    for conv, turn, role, text in talk_rows():
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if hit == 1 else text.translate(str.maketrans("", "", ".!?")) if hit == 2 else text
        want[conv, turn, "user" if hit == 4 else role, text] += {0: 0, 3: 2}.get(hit, 1)
    assert Counter(tuple(r) for r in cr.damaged(talks).collect()) == +want


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    audits = cr.conversation_audits(none)
    assert audits.count() == cr.repaired(none, audits).count() == cr.repaired_digests(none, audits).count() == 0


# word BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(wb.DEFAULT_VOCABULARY)


def coded(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_words_and_ids_are_the_librarys(library):
    v = wb.load_vocabulary()
    split = wb.Splitter(list(v.added))
    own = lambda t: [i for ws in split.windows(t) for w in ws for i in wb.merged(w, v)]
    draw = random.Random(3)
    letters = "aabbcdeéÅÅ'stre 0123!?\n\t<|endoftext|>Σİı中 ́"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(40)))
        text += "<|endoftext|>" * (draw.random() < 0.2) + text[:5]
        assert own(text) == coded(library, text)[0], text
    for c in range(0, 0x110000, 11):
        if not 0xD800 <= c < 0xE000:
            assert own(f"a{chr(c)}1{chr(c)}Z {chr(c)}") == coded(library, f"a{chr(c)}1{chr(c)}Z {chr(c)}")[0], hex(c)


def test_windows_cut_no_word(library, monkeypatch):
    monkeypatch.setattr(wb, "_WINDOW", 7)
    v = wb.load_vocabulary()
    split = wb.Splitter(list(v.added))
    for _, text in TEXTS[:10]:
        text = text or ""
        assert [i for ws in split.windows(text) for w in ws for i in wb.merged(w, v)] == coded(library, text)[0]


@pytest.mark.parametrize(("block_chars", "block_words"), [(40, 9), (wb.BLOCK_CHARS, 30), (wb.BLOCK_CHARS, wb.BLOCK_WORDS)])
def test_coding_equals_the_library(texts, library, block_chars, block_words):
    want = {(i, t): coded(library, t) for i, t in all_texts(texts)}
    got = wb.encode(texts, block_chars=block_chars, block_words=block_words)
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in got.collect()) == Counter((i, tuple(want[i, t][0])) for i, t in all_texts(texts))
    assert Counter(tuple(r) for r in wb.decode(got).collect()) == Counter((i, want[i, t][1]) for i, t in all_texts(texts))
    digests = Counter((i, len(x[0]), sha(" ".join(map(str, x[0]))), sha(x[1])) for i, t in all_texts(texts) for x in [want[i, t]])
    assert Counter(tuple(r) for r in wb.round_trip_digests(texts, block_chars=block_chars, block_words=block_words).collect()) == digests


def test_each_word_is_encoded_once(spark, texts):
    from twinweave.plans.scratch import Scratch

    v = wb.load_vocabulary()
    blocks = wb.split_blocks(texts, v, "doc_id", "text", 40, Scratch(spark, "test")).cache()
    words = {(r.block, r.place): r.word for r in wb.words_of(blocks).collect()}
    assert len(words) > len(set(words.values()))
    got = {}
    for r in wb.word_ids(blocks, v).collect():
        ids, ends = wb._unpack(r.ids).tolist(), wb._unpack(r.counts).cumsum().tolist()
        for place, a, b in zip(wb._unpack(r.places).tolist(), [0, *ends], ends, strict=False):
            got[r.block, place] = ids[a:b]
    assert got == {k: wb.merged(w, v) for k, w in words.items()}


def test_coding_of_nothing_and_odd_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert wb.encode(none).count() == wb.round_trip_digests(none).count() == 0
    odd = spark.createDataFrame([(1, [5, 99_999_999, None, 6]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    pieces = {r.token: r.piece for r in wb.piece_table(spark, wb.load_vocabulary()).filter("token in (5, 6)").collect()}
    assert {tuple(r) for r in wb.decode(odd).collect()} == {(1, f"{pieces[5]} {pieces[6]}"), (2, ""), (3, "")}


def test_queries_are_their_operators(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in wb.op13_word_bpe(spark, sf_dir).collect()}
    want = {i: (len(x[0]), sha(" ".join(map(str, x[0]))), sha(x[1])) for i, t in docs.items() for x in [coded(library, t)]}
    assert got == want
