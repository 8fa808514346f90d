import random
import re

import pytest

from wayfold.llm import grams
from wayfold.llm import truncation as T

SCHEMA = "doc_id long, text string, source string, kind string, key string, n int"


def docs(spark, data):
    return spark.createDataFrame([(*d, "open", "k", 1) for d in data], SCHEMA)


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("", "complete"), ("  \n", "complete"), ("All is well.", "complete"), ("All is well. [...]", "complete"), ("Is it?\r\n", "complete"), ('He said "yes."', "complete"), ("Done (see the sheet.)", "complete"),
        ("Text (see the sh", "broken"), ('Text "half', "broken"), ("路口�", "broken"), ("a \\u00e", "broken"), ("x &am", "broken"), ("see <b", "broken"), ("one, two,", "broken"),
        ('Log\n{"a": 1, "b": [1, 2]}', "complete"), ('Log\n{"a": 1, "b"', "broken"), ('Log\n{"a": 1, "b": [1', "broken"), ("T\n| a | b |", "complete"), ("T\n| a | b", "broken"),
        ("List\n- one\n- tw", "complete"), ("    run --now 12", "complete"), ("Ref: WO-12/3", "complete"), ("Text.\n-----", "complete"), ("Text.\n* * *", "complete"), ("Text.\nKind regards", "complete"), ("Text.\nMit freundlichen Grüßen", "complete"),
        ("Text.\n-- operator 4, shift B", "complete"), ("Text.\n[end of note]", "complete"), ("It stopped in the mid", "open"), ("It stopped in the (more)", "marked"), ("It stopped in the…", "marked"), ("第4车道有一辆货车停留了28分", "open"),
        ("Er sagte „nein“.", "complete"), ("Er sagte „nein", "broken"), ("5\" pipe fitted.", "complete"), ("smile :( end.", "complete"),
    ],
)
def test_structure(text, verdict):
    shape = T.structure(text)
    assert ("broken" if shape.open else shape.verdict) == verdict


WHOLE = [
    ("He said (see the\nappendix for the details.", True), ('He wrote "this is\nunfinished and ends.', True), ("A “quoted start\nthat goes on and ends.", True), ("<p>Hello <b>world.", True),
    ("Run this:\n```\nmake all\nmake test", True), ('Data:\n{\n "a": 1,\n "b": 2', True), ("function f() {\n  return 1;", True), ("Text <!-- a remark", True), ("See <a href=\"http://x", True), ("{\n\n  a: 1.", True),
    ("He said (see the\nappendix) for the details.", False), ('He wrote "this is\nfinished" and ends.', False), ("<p>Hello <b>world</b>.", False), ("<p>Hello<br>world.", False), ("Run this:\n```\nmake (all\n```", False), ('Data:\n{\n "a": "}",\n "b": 2\n}', False),
    ("A slip (here.\n\nThe next paragraph ends.", False), ('"One paragraph.\n\n"The next," they said.', False), ("We met R&D and AT&T", False), ("It rose by 50%", False), ("http://x/a%2Fb%2", True), ("if a<b then stop.", False), ("{name} was here.", False),
    ("- one (of\n- two", True), ("Open (\n-- operator 4", False), ("It ended. (more)", False), ("It ended.\n[...]", False), ("Er sagte „nein“ (laut).", False),
]


@pytest.mark.parametrize(("text", "cut"), WHOLE)
def test_the_whole_text_is_followed(text, cut):
    shape = T.structure(text)
    assert bool(shape.open or shape.verdict == "broken") == cut


def test_the_whole_text_decides(spark):
    got = {r["doc_id"]: r["truncated"] for r in T.judged(docs(spark, [(i, t, "a") for i, (t, _) in enumerate(WHOLE)])).collect()}
    assert [WHOLE[i][0] for i, cut in got.items() if WHOLE[i][1] and not cut] == []


def test_stack():
    kinds = lambda text: [k for k, _ in T.open_items(text)[0]]
    assert kinds("a (b [c] d") == ["("]
    assert kinds('a "b (c" d') == []
    assert kinds("a) b (c)") == []
    assert kinds('"a \\" b') == ['"']
    assert kinds("<div><b>x</b><i>y</div> <u>") == ["<"]
    assert kinds("{ ( \n\n [") == ["{", "["]


def test_open_items_that_are_usual_in_a_source_say_nothing(spark):
    data = [(i, f"Option {i} is shown as a) or (b and works.", "menus") for i in range(40)] + [(100, "Option 3 is shown as (b and works.", "other")]
    assert {r["doc_id"] for r in T.truncated(docs(spark, data)).collect()} == {100}


def test_words_as_the_pattern_cuts_them():
    """The array form against the pattern that states what a word and a sentence is."""
    word = re.compile(r"[\u3400-\u9fff\u3040-\u30ff]|[^\W_\u3400-\u9fff\u3040-\u30ff]+(?:[.:,'/-][^\W_\u3400-\u9fff\u3040-\u30ff]+)*")
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab1 .!?'-:\n。路口)\"_É") for _ in range(rng.randrange(40)))
        w = grams.words([text, "next one."])
        got = [int((w.terminated[w.sentence[w.text[w.sentence] == 0]]).sum()), int((w.text[w.sentence] == 0).sum())]
        done = total = 0
        for line in text.lower().splitlines():
            start = 0
            for m in T._SENTENCE.finditer(line):
                done += len(word.findall(line[start : m.start()]))
                start = m.end()
            total += len(word.findall(line))
        assert got == [done, total], text


def test_a_tail_that_mostly_goes_on_is_no_end(spark):
    """However often sentences end with these words, they must do so more often than they go on."""
    base = [(i, f"Unit {i} failed, which the desk of the north gate noted.", "log") for i in range(200)] + [(300 + i, f"Unit {i} was sent to the desk of the north gate.", "log") for i in range(20)]
    cut = "Somebody said that unit four failed badly, which the desk of the north gate"
    assert {r["doc_id"] for r in T.truncated(docs(spark, [*base, (999, cut, "log")])).collect()} == {999}


def corpus(n=1500, seed=1):
    """Sentences from templates; some texts are cut, some lack their last full stop, some are remarks."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["gate", "yard", "toll", "lane", "ramp", "bridge"])
    make = [
        lambda: f"The {word()} camera at {word()} {rng.randrange(100)} lost {rng.randrange(90)} frames before dawn",
        lambda: f"Operator {rng.randrange(50)} cleaned the {word()} lens and signed the sheet at {rng.randrange(10, 24)}:{rng.randrange(10, 60)}",
        lambda: f"Nobody touched the {word()} switch, yet the alerts stopped after the last restart",
    ]
    out, cut = [], set()
    for i in range(n):
        text = " ".join(rng.choice(make)() + "." for _ in range(rng.randint(1, 12)))
        source, kind = rng.choice(["log", "Log ", "note"]), rng.random()
        if source == "note" and len(text) > 200:
            text = text[:200]
            if text.rstrip()[-1] != ".":
                cut.add(i)
        elif kind < 0.05:
            text = text[: rng.randrange(len(text) // 2, len(text) - 8)].rstrip()
            if text[-1] != ".":
                cut.add(i)
        elif kind < 0.10:
            text = text[:-1]
        elif kind < 0.14:
            text = rng.choice(["Lane 3 open again", "Checked, stable", "Done at 10:45"])
        elif kind < 0.17:
            text += " More tomorrow..."
        elif kind < 0.19:
            text += rng.choice(["\nKind regards", "\n- item one", "\n-----"])
        out.append((i, text, source))
    return out, cut


def test_cut_texts_are_found(spark):
    data, cut = corpus()
    got = {r["doc_id"] for r in T.truncated(docs(spark, data)).collect()}
    missed, wrong = cut - got, got - cut
    assert len(missed) <= 0.03 * len(cut) and len(wrong) <= 0.02 * len(cut), (len(cut), [data[i] for i in sorted(missed)[:5]], [data[i][1][-80:] for i in sorted(wrong)[:5]])


def test_rates_per_source(spark):
    data, cut = corpus(seed=2)
    r = {x["source"]: x for x in T.rates(docs(spark, data)).collect()}
    assert set(r) == {"log", "note"} and sum(x["n_texts"] for x in r.values()) == len(data)
    want = sum(data[i][2] == "note" for i in cut) / sum(s == "note" for *_, s in data)
    assert abs(r["note"]["rate"] - want) < 0.03 and r["note"]["n_field_limit"] > 0


def test_defined_for_anything(spark):
    assert T.truncated(docs(spark, [])).count() == 0
    assert T.rates(docs(spark, [])).count() == 0
    odd = [(1, None, None), (2, "", "a"), (3, "   ", None), (4, "word " * 200_000 + "end.", "a"), (5, "(" * 5000, "a"), (None, "It stopped in the mid", None), (6, "It stopped in the mid", None), (6, "It stopped in the mid", None)]
    got = T.judged(docs(spark, odd)).collect()
    assert len(got) == 7
    assert {r["doc_id"]: r["truncated"] for r in got if r["doc_id"] in (2, 3, 4, 5)} == {2: False, 3: False, 4: False, 5: True}


def test_sources_without_full_stops(spark):
    """Where terminators are missing as a rule, a missing one says nothing."""
    data = [(i, f"Headline number {i} about the {'gate' if i % 2 else 'toll'} camera", "titles") for i in range(60)]
    assert T.truncated(docs(spark, data)).count() == 0
