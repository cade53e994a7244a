"""Template windows against brute force, and re-parameterised questions."""

import re

import pyarrow as pa
import pytest

from edge_rows import ROWS, documents, empty
from rankweave.llm import decontamination
from rankweave.llm.kernels import text_slices
from rankweave.llm.templates import NUMBER_WORDS, UNITS, canonical

QUESTION = "A train leaves the big station with {} cars and each car carries {} kg of coal for {} to the port."
ITEMS = [
    (1, QUESTION.format(12, 7, "Maria")), (2, QUESTION.format(15, 9, "Maria")), (3, None), (4, "12 13 14"), (5, ""),
    (6, "12 13 15"),
]


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_tables_match_brute_force(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    norm = lambda s: re.findall(r"\w+", s.lower())
    texts, wanted = {r.doc_id: norm(r.text) for r in docs.collect()}, set()
    for item in items.collect():
        words = norm(item.text)
        windows = {tuple(words[k : k + 8]) for k in range(len(words) - 7)}
        for doc_id, held in texts.items():
            here = {tuple(held[k : k + 8]) for k in range(len(held) - 7)}
            if 2 * len(windows & here) >= len(windows):
                wanted.add((doc_id, item.item_id))
    found = decontamination.contaminated(docs, items).collect()
    assert wanted and {(r.doc_id, r.item_id) for r in found} == wanted


def test_slots(spark):
    texts = {
        1: "Some text before this. " + QUESTION.format(12, 7, "Maria").replace("7 kg", "7kg") + " More",
        2: "they said that " + QUESTION.format(40, 3, "Peter") + " yes",
        3: "nothing of the kind",
        5: "so 12 13 14 is",
        6: QUESTION.format(15, 9, "Maria"),
        7: QUESTION.format(15, 9, "Maria").upper(),
        9: "it is 12 13 15 ok",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.kind) for r in decontamination.contaminated(docs, benchmark(spark)).collect()}
    assert found >= {(1, 1, "exact"), (2, 1, "reparameterised"), (5, 4, "exact"), (6, 2, "exact"), (9, 6, "exact")}
    assert {d for d, _, _ in found} <= {1, 2, 5, 6, 7, 9}


def test_contradicting_slots_do_not_match(spark):
    item = "first take 5 apples and then take 5 apples again and then take 5 apples more for us"
    docs = spark.createDataFrame(
        [(1, item.replace("5", "8")), (2, "first take 5 apples and then take 6 apples again and then take 7 apples more for us")],
        "doc_id long, text string",
    )
    found = decontamination.contaminated(docs, benchmark(spark, [(1, item)])).collect()
    assert [(r.doc_id, r.kind) for r in found] == [(1, "reparameterised")]


def test_edges(spark):
    docs = documents(spark, [*ROWS, (None, "12, 13, 14", "en", "s", 1)], clashes=True)
    kept = decontamination.remove_contaminated(docs, benchmark(spark))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert decontamination.contaminated(docs, benchmark(spark).limit(0)).count() == 0
    assert decontamination.contaminated(empty(spark), benchmark(spark)).count() == 0


MARBLES = "{0} has 5 marbles. {0} buys 7 more marbles at the shop. {0} loses 3 marbles. How many marbles does {0} have now?"


@pytest.mark.parametrize("name", ["Maria", "Mary Ann", "Tom"])
def test_names_that_open_sentences(spark, name):
    docs = spark.createDataFrame([(1, "We read this. " + MARBLES.format(name) + " Yes.")], "doc_id long, text string")
    found = decontamination.contaminated(docs, benchmark(spark, [(1, MARBLES.format("Tom"))])).collect()
    assert [(r.doc_id, r.item_id, r.kind) for r in found] == [(1, 1, "exact" if name == "Tom" else "reparameterised")]


def test_values_of_other_lengths_and_added_words(spark):
    text = QUESTION.format("five hundred", 7, "Mary Ann").replace("each car", "each single car")
    docs = spark.createDataFrame([(1, "so it says " + text)], "doc_id long, text string")
    found = decontamination.contaminated(docs, benchmark(spark)).collect()
    assert [(r.doc_id, r.item_id, r.kind) for r in found] == [(1, 1, "reparameterised")]


def test_two_items_of_one_template_are_two_rows(spark):
    docs = spark.createDataFrame(
        [(1, QUESTION.format(15, 9, "Maria") + " And more. " + QUESTION.format(12, 7, "Maria"))], "doc_id long, text string"
    )
    found = decontamination.contaminated(docs, benchmark(spark)).collect()
    assert sorted((r.doc_id, r.item_id, r.kind) for r in found) == [(1, 1, "exact"), (1, 2, "exact")]
    assert len({r.from_word for r in found}) == 2


def test_edited_copy_names_its_item(spark):
    cut = QUESTION.format(15, 9, "Maria").split(" to the port")[0].rsplit(" for ", 1)[0]
    docs = spark.createDataFrame([(1, "well " + cut + " and stops")], "doc_id long, text string")
    found = decontamination.contaminated(docs, benchmark(spark)).collect()
    assert [(r.item_id, r.kind) for r in found] == [(2, "edited")] and 0.5 <= found[0].coverage < 1


def tokens(*texts):
    (held,) = text_slices(pa.array(texts))
    return canonical(held)


def test_canonical_tokens():
    c = tokens("We saw Anna walk 5 km. Then 5km", "WE SAW")
    assert c.row.tolist() == [0] * 9 + [1] * 2
    assert c.slot.tolist() == [False, False, True, False, True, True, False, True, True, False, False]
    assert c.code[4] == c.code[7] and c.code[5] == c.code[8] and c.code[0] == c.code[9]


def test_runs_and_odd_words():
    c = tokens("he met Mary Ann Lee and paid five hundred dollars", "(“Été”) — naïve, été Ä 12,5% $3 £4")
    assert c.row.tolist() == [0] * 7 + [1] * 7
    assert c.slot.tolist()[:7] == [False, False, True, False, False, True, True]
    assert c.value[7] == c.value[9] and c.slot.tolist()[11:] == [True] * 3
    named = tokens("Mary Ann has 5. He met Bob").with_names()
    assert named.name.tolist() == [True, False, False, True, False, True] and named.place.tolist() == [0, 2, 3, 4, 5, 6]


def slow_tokens(text):
    """Kinds by rule, word by word, for texts of ASCII words without quotes."""
    out, opening = [], True
    for line in text.split("\n"):
        opening = True
        for word in line.split():
            core = re.sub(r"^[^\w$+-]+|[^\w%$]+$", "", word)
            if any(c.isalnum() for c in core):
                capital = core[0].isupper() and any(c.islower() for c in core[1:]) and core.lower() not in NUMBER_WORDS | UNITS
                out.append((core.lower(), capital and not opening, capital and opening))
                opening = False
            opening |= bool(re.search(r"[.!?:]\W*$", word)) and word[-1] in '.!?:")'
    return out


def test_classes_match_brute_force(spark, folder):
    docs = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").filter("lang = 'en'").limit(60).collect()]
    docs = [re.sub(r"[^A-Za-z.,!?:; \n()-]", "", t) for t in docs] + ["He said: Now. go (See.) Bob\nAnn - Eve"]
    for text in docs:
        want, c = slow_tokens(text), tokens(text)
        joined = [k for k, (_, name, _) in enumerate(want) if not (name and k and want[k - 1][1])]
        kept = [want[k] for k in joined]
        said = [w for w, *_ in kept]
        plain = [k for k in range(len(said)) if not kept[k][1]]
        assert len(c.row) == len(kept)
        assert [bool(c.name[k]) for k in range(len(kept))] == [name for _, name, _ in kept]
        assert [bool(x) for x in c.may_be_name] == [m for _, _, m in kept]
        firsts = {}
        for k in plain:
            assert firsts.setdefault(said[k], c.value[k]) == c.value[k]
