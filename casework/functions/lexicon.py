"""What the reader of item lines knows about words: a table of words and their roles. A user brings their own; these are defaults for
Spanish kitchen lines, written as stems and endings where a language forms words by rule."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Word:
    """A folded word and one role of it.

    Roles: ``unit`` (what it stands for, times how much), ``vessel`` (an amount without a size of its own), ``small`` and ``full`` (behind a spoon),
    ``number``, ``either`` and ``both`` (what joins alternatives and things eaten together), ``link`` (ties words into one name), ``aside`` (opens
    a remark on the thing before it), ``trait`` (describes the thing before it), ``advice`` (opens a sentence that names nothing), ``time`` (a
    stretch of time), ``heading`` (occurs in labels), ``head`` (names a thing of a kind by itself), ``residue`` (means nothing here)."""

    word: str
    role: str
    value: float | None = None
    stands_for: str | None = None


def plural(word: str) -> str:
    return word + ("s" if word[-1] in "aeiou" else "es")


def forms(stem: str) -> list[str]:
    """An adjective by gender and number: cocid- gives cocido, cocida, cocidos, cocidas."""
    return [stem + ending for ending in ("o", "a", "os", "as")]


def _units() -> Iterator[Word]:
    abbreviations = [("g", 1, "gram"), ("gr", 1, "gram"), ("kg", 1000, "gram"), ("ml", 1, "millilitre"), ("cl", 10, "millilitre"), ("l", 1000, "millilitre"), ("ud", 1, "piece")]
    words = [
        ("gramo", 1, "gram"),
        ("kilo", 1000, "gram"),
        ("mililitro", 1, "millilitre"),
        ("litro", 1000, "millilitre"),
        ("cucharada", 1, "tablespoon"),
        ("cucharadita", 1, "teaspoon"),
        ("lata", 1, "can"),
        ("loncha", 1, "slice"),
        ("rodaja", 1, "slice"),
        ("filete", 1, "slice"),
        ("punado", 1, "handful"),
        ("pizca", 1, "dash"),
        ("unidad", 1, "piece"),
        ("pieza", 1, "piece"),
        ("cazo", 1, "scoop"),
        ("capsula", 1, "capsule"),
        ("pastilla", 1, "capsule"),
        ("perla", 1, "capsule"),
    ]
    for word, times, unit in abbreviations:
        yield Word(word, "unit", times, unit)
    for word, times, unit in words:
        yield Word(word, "unit", times, unit)
        yield Word(plural(word), "unit", times, unit)


def default_words() -> list[Word]:
    """The defaults. Vessels are noted in the singular."""
    out = list(_units()) + [Word("grs", "unit", 1, "gram")]
    for word in ("vaso", "taza", "plato", "racion", "sobre", "bote", "hoja", "trozo", "paquete", "copa"):
        out += [Word(word, "vessel", None, word), Word(plural(word), "vessel", None, word)]
    for value, word in enumerate(("uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez"), 1):
        out.append(Word(word, "number", float(value)))
    out += [Word("un", "number", 1.0), Word("una", "number", 1.0), Word("medio", "number", 0.5), Word("media", "number", 0.5)]
    roles: dict[str, Iterable[str]] = {
        "small": ["postre", "cafe", "te", *forms("pequen")],
        "full": ["grande", "grandes", *forms("soper"), *forms("colmad"), *forms("ras")],
        "either": ["o", "u"],
        "both": ["y", "e", "con"],
        "link": ["de", "del", "la", "las", "los", "el", "a", "en"],
        "aside": ["sin", "al", "para", "por", "bajo", "baja"],
        "trait": ["natural", "integral", "integrales", "light", "vegetal", "verde", "verdes", "vapor", "plancha", "horno"]
        + [w for s in ("grieg", "cocid", "crud", "tostad", "fresc", "asad", "hervid", "rallad", "molid", "enter", "desnatad", "madur", "roj", "blanc", "negr", "casera", "picad") for w in forms(s)],
        "advice": ["no", "nada", "si", "toma", "tomar", "bebe", "beber", "come", "comer", "evita", "evitar", "espera", "esperar", "exprime", "exprimir", "mezcla", "mezclar", "cuando", "durante", "antes", "despues", "opcional", "importante", "recuerda", "siempre", "nunca", "maximo", "minimo"],
        "time": ["min", "minuto", "minutos", "h", "hora", "horas", "segundos", "dia", "dias", "semana", "semanas"],
        "heading": ["desayuno", "almuerzo", "comida", "merienda", "cena", "snack", "opcion", "alternativa", "entreno", "entrenar", "entrenamiento", "manana", "tarde", "noche", "suplemento", "suplementos", "dia", "descanso", "dormir", "levantarse"],
        "residue": ["tel", "tlf", "mail", "email", "correo", "correos", "web", "www", "http", "https"],
    }
    out += [Word(w, role) for role, words in roles.items() for w in dict.fromkeys(words)]
    kinds = {
        "meat": ["pollo", "pavo", "ternera", "lomo", "atun", "salmon", "merluza"],
        "grain": ["arroz", "pasta", "avena", "patata", "pan"],
        "plant": ["tomate", "lechuga", "pepino", "cebolla"],
        "fat": ["aceite", "nueces", "almendras"],
        "pill": ["zma", "maca", "creatina", "magnesio", "zinc"],
    }
    return out + [Word(w, "head", None, kind) for kind, words in kinds.items() for w in words]


#: Kinds of which two side by side are a choice; others side by side are eaten together.
CHOICES = ("meat", "grain")

#: Words that a joining word between them does not part.
TOGETHER = (("cafe", "leche"), ("te", "leche"), ("arroz", "leche"), ("pan", "tomate"), ("agua", "gas"))


def word_table(spark: SparkSession, words: Iterable[Word] | None = None) -> DataFrame:
    """One row per word: word, roles, and the value and meaning that belong to it. A word has one value and one meaning."""
    rows = [(w.word, w.role, None if w.value is None else float(w.value), w.stands_for) for w in (default_words() if words is None else words)]
    table = spark.createDataFrame(rows, "word string, role string, value double, stands_for string")
    return table.groupBy("word").agg(F.collect_set("role").alias("roles"), F.max("value").alias("value"), F.max("stands_for").alias("stands_for"))
