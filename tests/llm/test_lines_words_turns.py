"""Line dedup, spelling variants and conversation repair against plain second versions."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from casenet.llm import conversation_repair, line_dedup, queries, spelling_variants
from casenet.llm.conversation_repair import align
from casenet.plans.shared import exists, new_path

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
ASCII_LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Line dedup.


def plain_lines(docs: list[tuple], least_chars: int = 20, least_docs: int = 3) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, text that stays) of each row."""
    key = lambda line: line.strip(BLANK).translate(ASCII_LOWER)
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if doc_id is not None:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or doc_id == max(holders[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


MENU, MIXED = "Home | About | Contact us today", "ÀÉ The SAME line Of Many Documents ß"
LINES = [
    (1, f"{MENU}\nfirst text of its own, long enough\n{MENU}\n"), (2, f"  {MENU.upper()}\t\nsecond"), (7, f"{MENU}\nkept twice\n \x0b{MENU.lower()}\n"), (3, None), (4, ""), (5, "\n\n"), (6, "short\nshort"), (8, "short"), (9, "short\n" + "x" * 19),
    (10, MIXED), (11, f"{MIXED.replace('SAME', 'same')}\n{MIXED}"), (12, MIXED), (13, MIXED.replace("À", "à")), (13, f"{MENU}\nanother row of one id"), (13, f"{MENU}\nanother row of one id"), (None, f"{MENU}\nno id, not kept\n{MIXED}"),
    (14, "a line that two documents hold"), (15, "a line that two documents hold\n" * 3), (16, "x" * 19), (17, "x" * 19), (18, "\n".join(f"line {k} of a long text, quite long" for k in range(3000)) + f"\n{MENU}"), (19, "\n".join(f"line {k} of a long text, quite long" for k in range(0, 3000, 2))),
    (20, "\n".join(f"line {k} of a long text, quite long" for k in range(0, 3000, 3))),
]


def test_line_dedup_is_what_plain_counting_gives(spark):
    docs = spark.createDataFrame([(i, t, i, {"a": "b"}) for i, t in LINES], "doc_id bigint, text string, n_lines bigint, place map<string,string>")
    found = line_dedup.deduplicate(docs)
    assert found.columns == ["doc_id", "text", "place", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()), key=str) == plain_lines(LINES)


@pytest.mark.parametrize("batches", [1, 7])
def test_line_dedup_does_not_depend_on_the_number_of_batches(spark, batches):
    rng = random.Random(batches)
    docs = [(k, "\n".join(rng.choice(["A line that comes now and then %d", "  a LINE that comes now and then %d "]) % rng.randrange(40) for _ in range(rng.randrange(6)))) for k in range(60)]
    found = line_dedup.deduplicate(spark.createDataFrame(docs, "doc_id bigint, text string"), batches=batches, fanout=2)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()), key=str) == plain_lines(docs)


def test_line_dedup_over_all_ids_there_are(spark):
    line = "a line of the least and the greatest ids"
    docs = [(i, line) for i in (-(2**63), -(2**63) + 1, -1, 0, 2**53 + 1, 2**63 - 2, 2**63 - 1)]
    found = line_dedup.deduplicate(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()), key=str) == plain_lines(docs)


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.digests(line_dedup.deduplicate(spark.createDataFrame([], "doc_id bigint, text string"))).collect() == []


def keys(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, h1 bigint, h2 bigint")


def test_runs_are_merged_by_level_and_opened_again(spark):
    path = new_path(spark, "runs")
    runs = line_dedup.LineRuns(spark, path, buckets=2, fanout=2)
    for k in range(5):
        runs.add(keys(spark, [(10 - k, 1, 1), (10 - k, k, 7)]), f"b{k}")
    assert [level for level, _ in runs.live] == [2, 0]
    runs.close()
    again = line_dedup.LineRuns(spark, path)
    assert (again.buckets, again.live, again.batches) == (2, runs.live, runs.batches)
    again.add(keys(spark, [(10, 1, 1)]), "b0")  # a replay
    assert again.live == runs.live
    assert [tuple(r) for r in again.repeated().collect()] == [(1, 1, 10)]
    for k in range(2):
        again.add(keys(spark, [(3 - k, 4, 7)]), f"c{k}")
    assert sorted(tuple(r) for r in again.repeated().collect()) == [(1, 1, 10), (4, 7, 6)]
    again.delete()
    assert not exists(spark, path)


def test_a_settled_key_adds_no_row_to_a_run(spark):
    runs = line_dedup.LineRuns(spark, buckets=2, fanout=9)
    runs.add(keys(spark, [(k, 1, 1) for k in range(5)]), "a")
    runs.add(keys(spark, [(k, 1, 1) for k in range(5, 9)] + [(5, 2, 2)]), "b")
    assert [sorted((r.h1, r.n_docs) for r in run.collect()) for run in runs.runs()] == [[(1, 5)], [(2, 1)]]
    runs.delete()


def test_a_failure_before_the_manifest_leaves_the_runs_as_they_were(spark, monkeypatch):
    path = new_path(spark, "runs")
    runs = line_dedup.LineRuns(spark, path, buckets=2)
    runs.add(keys(spark, [(1, 1, 1)]), "a")
    with monkeypatch.context() as patched:
        patched.setattr(runs, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            runs.add(keys(spark, [(2, 1, 1), (3, 1, 1)]), "b")
    again = line_dedup.LineRuns(spark, path)
    assert again.batches == ["a"] and again.repeated().count() == 0
    again.add(keys(spark, [(2, 1, 1), (3, 1, 1)]), "b")
    assert [tuple(r) for r in again.repeated().collect()] == [(1, 1, 1)]


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.deduplicate(spark.createDataFrame(LINES, "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Spelling variants.


def plain_words(docs: list[tuple]) -> Counter:
    total: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return Counter({w: n for w, n in total.items() if len(w) >= 5 and n >= 3})


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_groups(words: dict[str, int]) -> list[tuple]:
    form, near = {}, {}
    for a in words:
        near[a] = [b for b in words if one_apart(a, b)]
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 2 * words[a] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def groups(df) -> list[tuple]:
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_spelling_variants_of_random_words(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abÀ") for _ in range(rng.randrange(1, 8))): rng.choice([3, 5, 6, 20, 50, 200]) for _ in range(400)}
    words |= {"a" * k: 2**k for k in range(1, 12)} | {"zzzzz": 4, "ÿ" * 300: 9, "ÿ" * 299 + "x": 3}
    assert groups(spelling_variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n bigint"))) == plain_groups(words)


def test_each_two_neighbours_meet_once_and_long_chains_end(spark):
    words = {"b" * k: 2**k for k in range(1, 40)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert spelling_variants.near_words(df).groupBy("word", "near").count().where("count > 1").isEmpty()
    assert {r.root for r in spelling_variants.group_variants(df).collect()} == {"b" * 39}


def test_words_are_counted_over_whole_texts(spark):
    docs = [(1, "Straße straße STRASSE naïve, Naïve naïve×÷ don't it's x_words_words words"), (2, None), (3, ""), (None, "words words WORDS straße ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ"), (4, "words " * 50_000), (4, "words " * 50_000), (5, "héllo" * 20_000), *((k, "planted mistakes everywhere") for k in range(300))]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id bigint, text string, n bigint, word string")
    counted = spelling_variants.count_words(df, misspell_every=97)
    assert {r.word: r.n for r in counted.collect()} == dict(plain_words(docs))
    assert groups(spelling_variants.group_variants(counted)) == plain_groups(plain_words(docs))


def test_spelling_variants_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling_variants.group_variants(spelling_variants.count_words(empty)).collect() == []


def test_the_query_of_spelling_variants_over_whole_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert groups(queries.op11_spelling_variants(spark, SF)) == plain_groups(plain_words(docs))


# Conversation repair.


def plain_align(codes: str) -> tuple[int, str]:
    """The cheapest, then least audit, by a search over (turns read, state of the grammar)."""
    wanted, heap, seen = {"0": "u", "s": "u", "a": "u", "u": "a"}, [(0, "", 0, "0")], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(codes) and state in "0a":
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        w = wanted[state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, w))
        if i < len(codes):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if codes[i] != "-":
                kind, extra = codes[i].lower(), codes[i].isupper()
                heapq.heappush(heap, (cost + extra + 2 * (kind != w), audit + ("K" if kind == w else "R"), i + 1, w))
                if state == "0" and kind == "s":
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, "s"))


def plain_repair(turns: list[tuple]) -> dict:
    """conv_id to its report, of rows (conv_id, turn, role, text, present)."""
    found = {}
    for conv in {t[0] for t in turns}:
        rows = sorted(((t[1], t[2] if t[2] is not None else " ", t[3] if t[3] is not None else " ") for t in turns if t[0] == conv and t[4]), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, codes, seen = Counter(), "", set()
        for _, role, text in rows:
            body = text.strip(BLANK)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "-" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        numbers = [r[0] for r in rows if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit = plain_align(codes)
        out, left, last = [], list(rows), ""
        for edit in audit:
            role, text = left.pop(0)[1:] if edit != "I" else ("", "")
            if edit in "RI":
                role = "assistant" if last == "u" else "user"
            if edit != "D":
                out.append(f"{role}:{text}")
                last = role[:1]
        found[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(out)))
    return found


def reports(df) -> dict:
    return {r.conv_id: tuple(r[c] for c in (*conversation_repair.REPORT, "repaired_sha256")) for r in df.collect()}


def test_alignment_is_the_cheapest_and_least_of_all():
    rng = random.Random(11)
    for size in [*range(9)] * 150 + [40, 90] * 10:
        codes = "".join(rng.choice(rng.choice(["suao-SUAO", "ua", "uuuuua-", "sssU", "uaUA-", "o-sS"])) for _ in range(size))
        assert align(codes) == plain_align(codes), codes


def test_a_long_conversation_is_aligned_within_its_band():
    rng = random.Random(3)
    codes = "".join("ua"[k % 2] if rng.random() > 0.1 else rng.choice("suao-UA") for k in range(1500))
    assert align(codes) == plain_align(codes)


def test_conversations_are_repaired_as_by_plain_search(spark):
    rng, turns = random.Random(8), []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(9)):
            turns.append((conv, rng.choice([turn, turn, turn, None, 2 * turn]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["yes.", "no!", "why? \t", "cut off", "", " \x0b\n", None, "été。", "a." * 10]), rng.random() > 0.15))
    turns += [(900, k, "user" if k % 2 else "system", f"turn {k}.", True) for k in range(300)] + [(901, 1, "user", "gone.", False), (902, None, "assistant", "ok.", True), (902, None, "assistant", "ok.", True)]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, present boolean, audit string, cost int")
    assert reports(conversation_repair.report_digests(df)) == plain_repair(turns)


def test_repaired_turns_follow_the_grammar(spark):
    turns = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes."), (2, 0, "system", "Be kind."), (2, 1, "assistant", "Hello!")]
    _, repaired = conversation_repair.repair(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    found = [tuple(r) for r in repaired.orderBy("conv_id", "position").collect()]
    assert found == [(1, 1, "K", "user", "Hi."), (1, 2, "I", "assistant", ""), (1, 3, "K", "user", "Again."), (1, 4, "K", "assistant", "Yes."), (2, 1, "K", "system", "Be kind."), (2, 2, "I", "user", ""), (2, 3, "K", "assistant", "Hello!")]


def test_no_conversations(spark):
    assert conversation_repair.report_digests(conversation_repair.damage(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).collect() == []


def test_the_query_of_conversation_repair_over_all_conversations(spark):
    turns = []
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        role, text = (" " if v is None else v for v in (r.role, r.text))
        kind = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        turns += [(r.conv_id, r.turn, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    assert reports(queries.op13_conversation_repair(spark, SF)) == plain_repair(turns)


def test_damage_reads_nulls_as_one_space(spark):
    rows = [(None if k % 2 else k, None if k % 3 else k, None, None) for k in range(60)]
    found = conversation_repair.damage(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    kinds = Counter(zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, _, _ in rows)
    assert found.count() == 60 + kinds[3] and found.where("not present").count() == kinds[0]
    assert found.where(F.col("role") == " ").count() + kinds[4] == found.count()
