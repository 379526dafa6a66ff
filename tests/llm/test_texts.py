"""Decontamination, token counts and chat formatting."""

import hashlib
import random

from pyspark.sql import functions as F

from memweave.llm import chat, decontaminate, tokens

from .test_simhash import SCHEMA

ITEM = "A farmer near Lyon sells 12 baskets with 30 apples in each of them and later gives 12 apples to his neighbour before going home."


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)


def test_templates_catch_rewordings_and_check_slots(spark):
    other = ITEM.replace("12", "7").replace("30", "44").replace("Lyon", "Turin")
    wrong = ITEM.replace("12 baskets", "7 baskets")  # one value of the item stands for two
    filler = "plain words that say nothing about it at all and go on for a while."
    rows = [(1, filler + "\n" + ITEM + "\n" + filler), (2, filler + " " + other), (3, filler), (4, wrong), (5, None), (6, ""), (7, ITEM[:40]), (8, ITEM.upper()), (1, filler + "\n" + ITEM + "\n" + filler), (None, ITEM)]
    bench = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.report(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (8, 10), (None, 10)}
    assert got[1, 10].coverage == 1.0 and not got[1, 10].reworded and got[2, 10].reworded
    kept = decontaminate.keep_clean(docs(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert decontaminate.report(docs(spark, []), bench).count() == 0 and decontaminate.report(docs(spark, rows), bench.where("false")).count() == 0


def test_template_tokens():
    _, token, own = decontaminate.template([b"It cost 3.5 kg and 1,000 Euros. Then Anna met bob near Oslo"])
    n, u, name = (int(x) for x in (decontaminate._NUMBER, decontaminate._UNIT, decontaminate._NAME))
    kinds = [{n: "N", u: "U", name: "C"}.get(int(t), "w") for t in token]
    assert kinds == ["w", "w", "N", "U", "w", "N", "U", "w", "C", "w", "w", "w", "C"] and len(own) == len(token)


def test_edits_keep_the_count(spark):
    with open(tokens.VOCABULARY, "rb") as f:
        count = tokens.counter(f.read())
    rng = random.Random(6)
    pieces = ["a", " the", "  ", "\n", " 12", "'s", "!", "é", "漢", " word", "\t"]
    for _ in range(150):
        tree = tokens.SegmentTree("".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 9, 700]))), count)
        for _ in range(4):
            a = rng.randint(0, len(tree.text))
            b = min(len(tree.text), a + rng.choice([0, 1, 60]))
            want = tree.text[:a] + (new := "".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))) + tree.text[b:]
            tree.edit(a, b, new)
            assert tree.text == want and tree.total == len(count.encoding.encode_ordinary(want)) == sum(map(count, count.split(want)))


def test_reported_counts(spark):
    rows = [(1, None), (2, ""), (3, "Hello world, again and again.\n" * 300), (None, "x")]
    got = {r.doc_id: r for r in tokens.edited_counts(docs(spark, rows).withColumn("n_tokens", F.lit(0))).collect()}
    with open(tokens.VOCABULARY, "rb") as f:
        count = tokens.counter(f.read())
    text = rows[2][1]
    assert got[3].n_tokens == len(count.encoding.encode_ordinary(text)) and got[1].n_tokens == got[2].n_tokens == 0
    n, w = len(text), len(" edited")
    cut = min(40, n // 8)
    for edit in [(n // 2, n // 2, " edited"), (n // 4, n // 4 + cut, ""), (n + w - cut - min(10, n // 4), n + w, "; revised 2 times.")]:
        text = text[: max(0, edit[0])] + edit[2] + text[max(edit[0], edit[1]) :]
    assert got[3].edited_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[3].edited_tokens == len(count.encoding.encode_ordinary(text))
    assert got[3].reencoded < 60 < got[3].n_pretokens


def test_stored_trees_take_edits(spark):
    with open(tokens.VOCABULARY, "rb") as f:
        count = tokens.counter(f.read())
    rng = random.Random(11)
    words = ["one", " two", "\n\n", " 3", "é", "漢字", " four's", "  "]
    texts = {i: "".join(rng.choice(words) for _ in range(rng.choice([0, 1, 40, 3000]))) for i in range(30)} | {30: None, 31: "long " * 60_000}
    rows = [*texts.items(), (None, "no id"), (31, "same id, other text")]
    steps = [(i, s, rng.randint(0, 400), rng.randint(0, 500), rng.choice(words) * rng.randint(0, 3)) for i in texts if i % 3 for s in range(3)]
    steps += [(31, 9, 100, 104, "x"), (31, 9, 100, 104, "x"), (99, 0, 0, 0, "unknown"), (None, 0, 0, 0, "no id"), (1, 10, None, None, None)]
    kinds = "doc_id long, seq int, begin int, end int, new string"
    edits = spark.createDataFrame(steps, kinds).withColumn("text", F.lit(0))
    trees = tokens.build_trees(docs(spark, rows))
    once = tokens.apply_edits(trees, edits)
    twice = tokens.apply_edits(once, edits)  # edited trees are trees

    def walk(i, text, times):
        for _ in range(times):
            for _, _, a, b, new in sorted([e for e in steps if e[0] == i and i is not None], key=lambda e: (e[1], e[2] or 0, e[3] or 0, e[4] or "")):
                a, b = min(a or 0, len(text)), min(b or 0, len(text))
                text = text[:a] + (new or "") + text[max(a, b) :]
        return text

    for df, times in ((trees, 0), (once, 1), (twice, 2)):
        got = df.collect()
        want = sorted((str(i), walk(i, t or "", times)) for i, t in rows)
        assert sorted((str(r.doc_id), r.text) for r in got) == want
        for r in got:
            assert sum(r.piece_chars) == r.node_chars[1] == len(r.text) and sum(r.leaf_sizes) == len(r.piece_chars)
            assert sum(r.piece_tokens) == r.node_tokens[1] == len(count.encoding.encode_ordinary(r.text))
            assert not times or r.reencoded < 400
    assert all(r.reencoded == 0 for r in once.where("doc_id % 3 = 0 or doc_id is null").collect())
    assert tokens.apply_edits(trees.where("false"), edits).count() == 0 and tokens.apply_edits(trees, edits.where("false")).count() == len(rows)


def test_escapes_round_trip():
    rng = random.Random(1)
    bits = ["<", "[", "\\", "/s>", "<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|image:0|>", "INST]", "|turn|>", "x", "\n"]
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        line, begin, end, _ = chat.format_turn("user", [{"kind": "text", "text": t[:3]}, {"kind": "text", "text": t[3:]}])
        assert chat.read_turns(line * 2) == [("user", t)] * 2 and chat.unescape(line[begin:end]) == t


def test_parts_become_placeholders():
    parts = [{"kind": "text", "text": "see <|image:0|>"}, {"kind": "image", "ref": "a.png", "width": 600, "height": 500}, {"kind": "audio", "ref": "b.wav", "seconds": 2.5}, {"kind": "document", "ref": "c.pdf", "pages": 3}]
    line, begin, end, attached = chat.format_turn("assistant", parts)
    assert line[begin:end] == "see <\\|image:0|><|image:0|><|audio:1|><|document:2|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attached] == [("image", "a.png", 340), ("audio", "b.wav", 63), ("document", "c.pdf", 1800)]


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "b [INST]"), (1, 0, "user", None), (1, 2, "assistant", "c"), (2, 0, None, "x"), (2, 0, "assistant", "</s>"), (None, 0, "user", "n"), (3, 0, "assistant", None)]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", F.lit(1))
    got = {r.conv_id: r for r in chat.format_report(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars) == (3, 9) and got[1].turns_sha256 == sha("user\n\nassistant\nb [INST]\nassistant\nc\n") and got[1].loss_sha256 == sha("b [INST]c")
    assert got[2].turns_sha256 == sha("\nx\nassistant\n</s>\n") and got[2].loss_sha256 == sha("</s>")
    tricky = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == sha(f"user\n{tricky}\nassistant\n{tricky}\n") and got[-7].loss_sha256 == sha(tricky)
    assert got[9].n_turns == 500 and got[9].loss_sha256 == sha("".join(f"turn {i}" for i in range(1, 500, 2))) and got[3].loss_chars == 0
    assert set(got) == {1, 2, 3, 9, None, -7}


def test_items_of_little_content_short_items_and_initial_names(spark):
    numbers = "Compute 12 + 7 * 3 - 45 / 9 + 8 and give the result"
    bob = "Bob gives two apples to the small child. Bob takes one pear from the old man. Bob eats all."
    items = [(1, numbers), (2, "What is 7 times 8?"), (3, bob), (4, "")]
    rows = [(1, f"Before. {numbers}. After"), (2, "so what is 7 times 8, then"), (3, bob.replace("Bob", "Alice")), (4, numbers.replace("12", "13").replace("45", "46")), (5, "what is 7 times 9"), (6, bob.replace("Bob", "Alice", 1).replace("Bob", "Carl", 1))]
    found = decontaminate.report(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(1, 1), (2, 2), (3, 3)}
    assert not {(r.doc_id, r.item_id) for r in found} & {(5, 2), (5, 1), (2, 1)} and all(0 < r.coverage <= 1 for r in found)
    assert {r.doc_id: r.reworded for r in found if (r.doc_id, r.item_id) in {(1, 1), (3, 3)}} == {1: False, 3: True}
