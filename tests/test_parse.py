"""The reader of item lines, line by line."""

from __future__ import annotations

import pytest

from casework.functions.lexicon import Word, word_table
from casework.operators.parse import parse_components, promote_embedded_quantity, propagate_quantity

NONE = (None, None, None, None)
LINES = {
    # amounts
    "90 g merluza": [(90, "gram", None, "merluza")],
    "0,25 kg de fresas": [(250, "gram", None, "fresas")],
    "2 cl de licor": [(20, "millilitre", None, "licor")],
    "tres ciruelas (pasas)": [(3, "piece", None, "ciruelas")],
    "¾ pepino": [(0.75, "piece", None, "pepino")],
    "1 ½ pomelo": [(1.5, "piece", None, "pomelo")],
    "2/3 mango": [(2 / 3, "piece", None, "mango")],
    "una cucharada rasa de lino": [(1, "tablespoon", None, "lino")],
    "2 cucharadas de postre de mermelada": [(2, "teaspoon", None, "mermelada")],
    "3 cucharaditas del bote": [(3, "teaspoon", None, "bote")],
    "4 vasos grandes de horchata": [(4, None, "vaso", "horchata")],
    "cucharada de tahini": [(None, "tablespoon", None, "tahini")],
    "5 filetes": [(5, "piece", None, "filetes")],
    "Gazpacho": [(None, None, None, "Gazpacho")],
    # ranges and lists of numbers
    "3 a 5 higos": [(4, "piece", None, "higos")],
    "10 / 12 rodajas de chorizo": [(11, "slice", None, "chorizo")],
    "20 - 25 gr nata": [(22.5, "gram", None, "nata")],
    "80, 90, 110 gr lentejas": [(80, "gram", None, "lentejas")],
    "omega 3, 6, 9": [(None, None, None, "omega 3 6 9")],
    # alternatives
    "70 gr cordero / 75 gr conejo / 2 codornices": [(70, "gram", None, "cordero"), (75, "gram", None, "conejo"), (2, "piece", None, "codornices")],
    "60 gr sardina, caballa o trucha": [(60, "gram", None, "sardina"), (60, "gram", None, "caballa"), (60, "gram", None, "trucha")],
    "requesón fresco o rallado": [(None, None, None, "requesón fresco o rallado")],
    "kéfir u horchata sin gluten": [(None, None, None, "kéfir"), (None, None, None, "horchata sin gluten")],
    "120 gr (garbanzos o alubias)": [(120, "gram", None, "garbanzos"), (120, "gram", None, "alubias")],
    "ternera pavo": [(None, None, None, "ternera"), (None, None, None, "pavo")],
    # things taken together
    "2 tostadas y 30 gr jamón + un caqui": [(2, "piece", None, "tostadas"), (30, "gram", None, "jamón"), (1, "piece", None, "caqui")],
    "acelgas, nabo, apio": [(None, None, None, "acelgas"), (None, None, None, "nabo"), (None, None, None, "apio")],
    "muesli en 150 ml de bebida": [(None, None, None, "muesli"), (150, "millilitre", None, "bebida")],
    "trucha ahumada40 gr pistachos": [(None, None, None, "trucha ahumada"), (40, "gram", None, "pistachos")],
    "magnesio 2 zinc": [(None, None, None, "magnesio"), (2, "piece", None, "zinc")],
    "arroz tomate": [(None, None, None, "arroz"), (None, None, None, "tomate")],
    "aceite de almendras": [(None, None, None, "aceite de almendras")],
    "té con leche": [(None, None, None, "té con leche")],
    "queso, sin sal": [(None, None, None, "queso sin sal")],
    # embedded amounts
    "1 tarrina de 200 gr requesón": [(200, "gram", "gr", "tarrina de requesón")],
    "1 brick de 1 l": [(1000, "millilitre", "l", "brick")],
    "2 packs de 50 gr": [(2, "piece", None, "packs de 50 gr")],
    # labels
    "Cena: 2 calabacines": [(2, "piece", None, "calabacines")],
    "Merienda 18:30: 1 pera": [(1, "piece", None, "pera")],
    "después de entrenar: 35 gr dátiles": [(35, "gram", None, "dátiles")],
    "7: tofu": [(None, None, None, "tofu")],
    "salsa: romesco": [(None, None, None, "salsa romesco")],
    # advice and residue
    "15 min": [NONE],
    "1 exprimir una lima": [NONE],
    "Beber mucha agua": [NONE],
    "No cenar o 2 huevas": [(2, "piece", None, "huevas")],
    "Nada o 2 litros de agua": [NONE],
    "tel / email:": [NONE],
    "---": [NONE],
    "": [NONE],
    "Comida:": [NONE],
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, t) for i, t in enumerate(LINES)] + [(1000, None)]
    frame = spark.createDataFrame(rows, "line_id long, line string")
    return promote_embedded_quantity(propagate_quantity(parse_components(frame))).orderBy("line_id", "alt_no", "comp_no").collect()


@pytest.mark.parametrize("text", LINES)
def test_line(parsed, text):
    got = [(r.quantity, r.unit, r.raw_unit, r.name) for r in parsed if r.line == text]
    assert got == [(pytest.approx(q) if q else q, *rest) for q, *rest in LINES[text]]


def test_flags_and_numbers(parsed):
    by = {t: [r for r in parsed if r.line == t] for t in LINES}
    assert [r.is_advice for r in by["15 min"]] == [True] and by["1 exprimir una lima"][0].is_advice and by["Beber mucha agua"][0].is_advice
    assert by["tel / email:"][0].is_noise and by["---"][0].is_noise and not by["---"][0].is_advice
    assert by["tres ciruelas (pasas)"][0].note == "pasas" and by["120 gr (garbanzos o alubias)"][0].note is None
    assert {(r.alt_no, r.comp_no, r.alternatives, r.components) for r in by["70 gr cordero / 75 gr conejo / 2 codornices"]} == {(0, 0, 3, 1), (1, 0, 3, 1), (2, 0, 3, 1)}
    assert {(r.alt_no, r.comp_no, r.alternatives, r.components) for r in by["acelgas, nabo, apio"]} == {(0, 0, 1, 3), (0, 1, 1, 3), (0, 2, 1, 3)}
    assert not [r for r in parsed if r.line_id == 1000]


def test_repeated_ids_and_lines_stay_apart(spark):
    rows = [(1, "50 gr nabo o apio"), (1, "60 gr nabo o apio"), (1, "apio o nabo"), (1, "apio o nabo"), (None, "2 kiwis")]
    got = propagate_quantity(parse_components(spark.createDataFrame(rows, "line_id long, line string"))).collect()
    assert sorted((r.quantity or 0, r.name) for r in got if r.line_id == 1) == [(0, "apio"), (0, "apio"), (0, "nabo"), (0, "nabo"), (50, "apio"), (50, "nabo"), (60, "apio"), (60, "nabo")]
    assert [(r.quantity, r.name) for r in got if r.line_id is None] == [(2, "kiwis")]


def test_words_are_an_argument(spark):
    words = word_table(spark, [Word("cups", "unit", 240.0, "millilitre"), Word("or", "either"), Word("and", "both"), Word("of", "link")])
    got = parse_components(spark.createDataFrame([(1, "2 cups milk or cream and 3 figs")], "line_id long, line string"), words).orderBy("alt_no", "comp_no").collect()
    assert [(r.quantity, r.unit, r.name) for r in got] == [(480, "millilitre", "milk"), (None, None, "cream"), (3, "piece", "figs")]


@pytest.mark.parametrize("step", [propagate_quantity, promote_embedded_quantity])
def test_empty(spark, step):
    rows = spark.createDataFrame([], "line_id long, line string")
    assert step(parse_components(rows)).count() == 0


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    from casework.operators import parse

    monkeypatch.setattr(parse, "LINES_PER_TASK", 5)
    lines = spark.range(200).selectExpr("id AS line_id", "'10 g arroz' AS line")
    found = parse.parse_components(lines)
    assert "hashpartitioning(line_id" in (plan := found._jdf.queryExecution().executedPlan().toString())
    assert ", 40), REPARTITION_BY_NUM" in plan
    assert found.count() == 200


def test_a_text_that_many_lines_say_is_read_once(spark, monkeypatch):
    from casework.operators import parse

    seen, parted = [], parse._parted
    monkeypatch.setattr(parse, "_parted", lambda tokens, *rest: seen.append(tokens) or parted(tokens, *rest))
    lines = [(i, "30 gr pan") for i in range(50)] + [(7, "30 gr pan"), (None, "30 gr pan"), (8, "2 latas de maiz"), (9, None)]
    got = parse.parse_components(spark.createDataFrame(lines, "line_id long, line string")).collect()
    assert sorted((r.line_id is not None, r.line_id or 0, r.copy_no, r.line) for r in got) == sorted(
        [(True, i, 1, "30 gr pan") for i in range(50)] + [(True, 7, 2, "30 gr pan"), (False, 0, 1, "30 gr pan"), (True, 8, 1, "2 latas de maiz")]
    )
    assert seen[0].select("line").distinct().count() == 2 and seen[0].count() < 10
