"""One consistent form for text that looks alike and differs in its characters.

DuckDB runs inside the Arrow partitions: each batch is registered as a table and one SQL statement maps
compatibility forms, invisible characters, blanks, split accents and look-alike letters. No shuffle, no state.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cyrillic and Greek letters drawn like a Latin one, and that Latin letter.
SAME = "АВЕКМНОРСТУХІЈЅаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
SAME_LATIN = "ABEKMHOPCTYXIJSaeopcyxijsdqwhABEZHIKMNOPTYXo"
#: Nearly alike: replaced only beside a Latin letter of the same word.
NEAR = "αινρυκвкмнт"
NEAR_LATIN = "aivpukbkmht"
#: What canonical columns are called, after their field.
SUFFIX = "_canonical"
#: Invisible characters.
INVISIBLE = r"[\x{00ad}\x{034f}\x{061c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}\x{fff9}-\x{fffb}\x{e0001}-\x{e007f}]"
#: Blanks other than the plain space.
BLANK = r"[\t\n\x0b\f\r\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def compatibility_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility form is one other character, and those whose form is several, from Unicode."""
    one, many = {}, {}
    for code in range(0xA1, sys.maxunicode + 1):
        char = chr(code)
        if "<" not in unicodedata.decomposition(char):
            continue
        plain = unicodedata.normalize("NFKC", char)
        if plain == char or plain.startswith(" "):
            continue
        (one if len(plain) == 1 else many)[char] = plain
    return one, many


def _char_class(chars: Sequence[str]) -> str:
    """A regular expression class of the characters, as ranges."""
    codes, ranges = sorted(map(ord, chars)), []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else "") for a, b in ranges) + "]"


def _statement(keep: Sequence[str], fields: Sequence[str]) -> str:
    """The SQL that adds a canonical column per field to the rows of ``batch``."""
    one, many = compatibility_forms()
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    name = lambda column: '"' + column.replace('"', '""') + '"'
    word = r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}]"
    other = r"[^\p{Latin}\p{Greek}\p{Cyrillic}\p{M}]"
    foreign = f"[{SAME}{NEAR}]"
    # Letters of the foreign scripts that are no look-alike: a word with one of them is a real foreign word.
    real = "[" + "".join(chr(c) for c in (*range(0x370, 0x400), *range(0x400, 0x530)) if unicodedata.category(chr(c))[0] == "L" and chr(c) not in SAME + NEAR) + "]"
    strange_one, strange_many = _char_class(list(one)), _char_class(list(many))
    pairs = ", ".join(f"{quote(a)}: {quote(b)}" for a, b in many.items())
    steps = [
        f"CASE WHEN regexp_matches(\0, {quote(strange_one)}) THEN translate(\0, {quote(''.join(one))}, {quote(''.join(one.values()))}) ELSE \0 END",
        f"CASE WHEN regexp_matches(\0, {quote(strange_many)}) THEN array_to_string(list_transform(string_split(\0, ''), lambda ch: coalesce((MAP {{{pairs}}})[ch], ch)), '') ELSE \0 END",
        f"nfc_normalize(regexp_replace(\0, {quote(INVISIBLE)}, '', 'g'))",
        f"trim(regexp_replace(\0, {quote(BLANK)}, ' ', 'g'))",
        f"""CASE WHEN regexp_matches(\0, {quote(foreign)}) THEN nfc_normalize(array_to_string(list_transform(
  regexp_extract_all(\0, {quote(word + "+|" + other + "+")}),
  lambda w: CASE WHEN regexp_matches(w, {quote(real)}) THEN w
    WHEN regexp_matches(w, {quote(chr(92) + "p{Latin}")}) THEN translate(w, {quote(SAME + NEAR)}, {quote(SAME_LATIN + NEAR_LATIN)})
    WHEN regexp_full_match(w, {quote("[" + SAME + chr(92) + "p{M}]+")}) THEN translate(w, {quote(SAME)}, {quote(SAME_LATIN)})
    ELSE w END), '')) ELSE \0 END""",
    ]
    kept = ", ".join(name(c) for c in keep)
    sql = [f"s0 AS (SELECT {kept}, {', '.join(f'{name(f)} AS __x{i}' for i, f in enumerate(fields))} FROM batch)"]
    for j, step in enumerate(steps, 1):
        sql.append(f"s{j} AS (SELECT {kept}, {', '.join(step.replace(chr(0), f'__x{i}') + f' AS __x{i}' for i in range(len(fields)))} FROM s{j - 1})")
    return f"WITH {', '.join(sql)} SELECT {kept}, {', '.join(f'__x{i} AS {name(f + SUFFIX)}' for i, f in enumerate(fields))} FROM s{len(steps)}"


def settled() -> str:
    """A regular expression of the texts whose canonical form is the text itself without the spaces at its ends.

    It asks for characters of the common blocks of Latin letters, signs and Han only, each of which no step changes and
    none of which composes with another.
    """
    codes = [*range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x3001, 0x3030), *range(0x4E00, 0xA000)]

    def kept(char: str) -> bool:
        form = unicodedata.category(char)
        return form[0] in "LNPS" and not unicodedata.decomposition(char).startswith("<") and unicodedata.normalize("NFC", char) == char and char not in SAME + NEAR

    return "[" + "".join(re.escape(chr(c)) for c in codes if c == 0x20 or kept(chr(c))) + "]*"


def plain_forms() -> dict[int, str]:
    """For ``str.translate``: compatibility forms to plain characters, invisible characters to nothing, blanks to spaces."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    found = lambda chars: re.findall(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", chars), every)
    one, many = compatibility_forms()
    return str.maketrans(dict.fromkeys(found(INVISIBLE), "") | dict.fromkeys(found(BLANK), " ") | one | many)


class Canonical:
    """The canonical form of texts within a Python process.

    Only texts that are not :func:`settled`, as they are or with :func:`plain_forms`, go through the SQL.
    """

    def __init__(self, statement: str, settled: str, plain: dict[int, str]) -> None:
        self.statement, self.settled, self.plain = statement, re.compile(settled).fullmatch, plain
        self.connection = None

    @staticmethod
    def plan() -> tuple[str, str, dict[int, str]]:
        """The arguments, made once on the driver."""
        return _statement(["text"], ["text"]), settled(), plain_forms()

    def __call__(self, texts: Iterable[str | None]) -> list[str | None]:
        texts, forms = list(texts), {}
        for text in texts:
            if text and not self.settled(text) and text not in forms:
                plain = text.translate(self.plain)
                forms[text] = plain.strip(" ") if self.settled(plain) else None
        odd = [text for text, form in forms.items() if form is None]
        if odd:
            if self.connection is None:
                import duckdb

                self.connection = duckdb.connect(config={"threads": 1})
                self.connection.execute("CREATE TABLE batch (text VARCHAR)")
                self.connection.execute("PREPARE form AS " + self.statement)
            self.connection.register("odd", pa.table({"text": pa.array(odd, pa.string())}))
            self.connection.execute("DELETE FROM batch")
            self.connection.execute("INSERT INTO batch SELECT text FROM odd")
            self.connection.unregister("odd")
            forms.update(self.connection.execute("EXECUTE form").fetchall())
        return [text and (text.strip(" ") if (form := forms.get(text)) is None else form) for text in texts]


def canonical(df: DataFrame, keep: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The ``keep`` columns and, for each text field, ``<field>_canonical``, one row per input row.

    Null stays null, a text of blanks and invisible characters becomes ``''``. Whole Greek, Cyrillic and kana words
    and composed accents stay as they are; a word is turned to Latin letters only where it has a Latin letter beside
    look-alikes, or consists of look-alikes throughout. Only the columns named are read; ``keep`` and ``fields`` may
    overlap. Columns beginning with ``__x`` must not be kept.
    """
    keep = list(dict.fromkeys(keep))
    statement = _statement(keep, fields)
    schema = T.StructType([f for f in df.select(*keep).schema] + [T.StructField(f + SUFFIX, T.StringType()) for f in fields])
    needed = list(dict.fromkeys([*keep, *fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        connection = duckdb.connect(config={"threads": 1})
        connection.execute("SET preserve_insertion_order = true")
        for batch in batches:
            if batch.num_rows:
                connection.register("batch", pa.Table.from_batches([batch]))
                yield from connection.sql(statement).to_arrow_table().to_batches()
                connection.unregister("batch")

    return df.select(*[F.col(f"`{c}`") for c in needed]).mapInArrow(run, schema)


def disguised(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key``, ``field``, ``value``, ``canonical`` for every non-null value that is not in canonical form."""
    wide = canonical(df, [key, *fields], fields)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value"), F.col(f"`{f + SUFFIX}`").alias("canonical")) for f in fields])
    apart = F.col("value").rlike("[\\x{300}-\\x{36f}]")
    return wide.select(key, F.inline(cells)).where((F.col("value") != F.col("canonical")) | apart)
