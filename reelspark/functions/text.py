"""String functions as column expressions; Unicode composition and case folding, which Spark lacks, as Arrow UDFs."""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def composed(c: Column, form: str = "NFC", fold: bool = False) -> Column:
    """In a Unicode normal form; with ``fold`` without case."""

    @F.pandas_udf("string")
    def normal(column: pd.Series) -> pd.Series:
        column = column.str.normalize(form)
        return column.str.casefold() if fold else column

    return normal(c)


def nfc_collapse(c: Column) -> Column:
    """Composed (NFC), and collapsed."""
    return collapse(composed(c))


def required(c: Column, name: str) -> Column:
    """A text composed and collapsed; a null or blank one is an error."""
    clean = nfc_collapse(c)
    return F.when(F.coalesce(clean, F.lit("")) == "", F.raise_error(F.lit(f"{name} must not be empty"))).otherwise(clean)


def json_has(c: Column, wanted: dict, path: str = "$") -> Column:
    """Whether a JSON text has all that ``wanted`` has, at any depth, whatever else it has."""
    out = F.lit(True)
    for key, value in wanted.items():
        at = f"{path}.{key}"
        found = json_has(c, value, at) if isinstance(value, dict) else F.get_json_object(c, at) == F.lit(str(value))
        out = out & F.coalesce(found, F.lit(False))
    return out


def _objects(said: str) -> Iterator[dict]:
    """The JSON objects in a text, in order of where they begin, inner ones too."""
    def refused(name: str) -> None:
        raise ValueError(f"{name} is no JSON")

    decoder, at = json.JSONDecoder(parse_constant=refused), said.find("{")
    while at >= 0:
        try:
            yield decoder.raw_decode(said, at)[0]
        except (ValueError, RecursionError):
            pass
        at = said.find("{", at + 1)


def first_object(c: Column) -> Column:
    """The first JSON object inside free text, whatever is nested in it or quoted, as compact JSON; null if there is none."""

    @F.pandas_udf("string")
    def first(column: pd.Series) -> pd.Series:
        compact = lambda said: next((json.dumps(o, separators=(",", ":"), ensure_ascii=False) for o in _objects(said)), None)
        return column.map(compact, na_action="ignore")

    return first(c)


def _grounded(value: dict) -> tuple | None:
    """(answer, frame, answerable, confidence) of an object that has them in the right form."""
    line = lambda key: " ".join(str(value.get(key, "")).split())
    sure = pd.to_numeric(pd.Series([value.get("confidence", 0.5)]), errors="coerce")[0]
    can = value.get("answerable", True)
    good = line("answer") and line("selected_frame_id") and can in (True, False) and isinstance(can, bool) and 0 <= sure <= 1
    return (line("answer")[:100], str(value["selected_frame_id"]).strip(), can, float(sure)) if good else None


def grounded_answer(c: Column) -> Column:
    """A model's answer (answer, frame, answerable, confidence): of the first JSON object in its text that names an answer and
    a frame, and, if it says so, whether there is an answer (else true) and how sure it is (0 to 1; else a half).  Null if
    there is none."""

    @F.pandas_udf("answer string, frame string, answerable boolean, confidence double")
    def parsed(column: pd.Series) -> pd.DataFrame:
        found = [next(filter(None, map(_grounded, _objects(x or ""))), (None,) * 4) for x in column]
        return pd.DataFrame(found, columns=["answer", "frame", "answerable", "confidence"])

    out = parsed(c)
    return F.when(out["answer"].isNotNull(), out)


def snapshot(c: Column) -> Column:
    """A hint as compared between snapshots: blanks collapsed, none before , . ; : ! ? and one after."""
    c = F.regexp_replace(nfc_collapse(c), r"\s+([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(c, r"([,.;:!?])(?=[^\s,.;:!?])", "$1 "))


def semantic_key(c: Column) -> Column:
    """What is left without punctuation, separators and case."""
    return composed(F.regexp_replace(c, r"[\p{P}\p{Z}\s]", ""), fold=True)


def snapshot_change(before: Column, now: Column) -> tuple[Column, Column]:
    """(kind, delta): FIRST, APPEND (and what was appended), NO_CHANGE or REPLACEMENT."""
    a, b = snapshot(before), snapshot(now)
    same, longer = semantic_key(a) == semantic_key(b), b.startswith(a)
    kind = F.when(before.isNull(), "FIRST").when(same, "NO_CHANGE").when(longer, "APPEND").otherwise("REPLACEMENT")
    delta = F.when(before.isNull(), b).when(~same & longer, F.trim(F.substring(b, F.length(a) + 1, F.length(b))))
    return kind, delta


def clipped_words(c: Column, n: int) -> Column:
    """The first n words."""
    return F.array_join(F.slice(F.split(collapse(c), " "), 1, n), " ")


def sections(parts: list[tuple[str, Column, int]]) -> Column:
    """"[NAME]" sections of at most so many words each, a blank line between; null if there is none."""
    each = [F.when(F.length(collapse(c)) > 0, F.concat(F.lit(f"[{name}]\n"), clipped_words(c, n))) for name, c, n in parts]
    return F.nullif(F.concat_ws("\n\n", *each), F.lit(""))


# Phrases that state how a hint stands to the one before it.
AT_END = ("cuối cùng", "ở cuối cảnh", "at the end", "finally")
OVERLAP = ("đồng thời", "cùng lúc", "trong lúc", "simultaneously", "at the same time")
BEFORE = ("sau đó", "rồi", "then")


def says(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of some phrases."""
    out = F.lit(False)
    for p in phrases:
        out = out | c.contains(p)
    return out


def temporal_relation(c: Column, has_previous: Column) -> Column:
    """The relation that a hint's phrases state: AT_END, of a first hint too; after another one OVERLAP or BEFORE; null
    where nothing is said."""
    c = collapse(composed(c, fold=True))
    return F.when(says(c, AT_END), "AT_END").when(has_previous & says(c, OVERLAP), "OVERLAP").when(has_previous & says(c, BEFORE), "BEFORE")


# The kinds of questions, by the first of these that holds one of its terms.
QUESTIONS = {
    "COUNT": ("how many", "bao nhiêu", "mấy ", "số lượng"),
    "COLOR": ("what color", "which color", "màu gì", "màu nào"),
    "TEXT": ("what does", "written", "read", "chữ gì", "ghi gì", "biển"),
    "SPEECH": ("say", "said", "tell", "nói gì", "đọc gì", "hỏi gì"),
    "TEMPORAL": ("before", "after", "then", "trước", "sau", "tiếp theo", "vì sao"),
    "IDENTITY": ("who", "what is", "which object", "ai ", "là gì", "vật gì"),
}
# The evidence asked for besides what is seen, letters and words that only Vietnamese has.
EVIDENCE = {"TEXT": "OCR,VISUAL", "SPEECH": "ASR,VISUAL"}
LETTERS = "ăâđêôơư"
VIETNAMESE = ("gì", "nào", "bao", "người", "trước", "sau")


def question_kind(c: Column) -> Column:
    """The kind of a question; GENERAL if no term is there."""
    c = composed(nfc_collapse(c), "NFKC", fold=True)
    out = F.when(F.lit(False), "")
    for kind, terms in QUESTIONS.items():
        out = out.when(says(c, terms), kind)
    return out.otherwise("GENERAL")


def evidence_of(kind: Column) -> Column:
    """The sources of evidence that a kind of question asks for."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv]), kind), F.lit("VISUAL"))


def question_language(c: Column) -> Column:
    """The language to answer in: vi or en."""
    words = r"(^|[^\p{L}\p{N}_])(" + "|".join(VIETNAMESE) + r")($|[^\p{L}\p{N}_])"
    c = composed(nfc_collapse(c), "NFKC", fold=True)
    return F.when(c.rlike(f"[{LETTERS}]|{words}"), "vi").otherwise("en")


# Counts as digits, and the colours that are kept as they are.
COUNTS = {
    "zero": "0", "không": "0", "one": "1", "một": "1", "mot": "1", "two": "2", "hai": "2", "three": "3", "ba": "3",
    "four": "4", "bốn": "4", "five": "5", "năm": "5", "six": "6", "sáu": "6", "seven": "7", "bảy": "7", "eight": "8",
    "tám": "8", "nine": "9", "chín": "9", "ten": "10", "mười": "10",
}


def answer_key(c: Column, kind: Column) -> Column:
    """An answer as compared: without case and marks but hyphens; for a COUNT, a number word as digits.  Colours stay in
    their language."""
    plain = collapse(F.regexp_replace(composed(c, fold=True), r"[^\p{L}\p{N}_\s-]", " "))
    digits = F.create_map(*[F.lit(x) for kv in COUNTS.items() for x in kv])
    return F.when(kind == "COUNT", F.coalesce(F.try_element_at(digits, plain), plain)).otherwise(plain)


def tokens(c: Column) -> Column:
    """The distinct words of more than one character."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)")), lambda w: F.length(w) > 1))


def token_overlap(a: Column, b: Column) -> Column:
    """The share of a's tokens that b has; 0 if it has none."""
    x = tokens(a)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, tokens(b))) / F.size(x)).otherwise(0.0)


def bounded_error(c: Column, n: int = 300) -> Column:
    """An error on one line of at most n characters, secrets masked."""
    masked = F.regexp_replace(c, r"(?i)(token|key|secret|password)\s*[=:]\s*\S+", "$1=***")
    return F.substring(collapse(masked), 1, n)


def short_answer(c: Column, n: int = 100) -> Column:
    """A model's answer: what follows its thoughts, without fences, on one line, at most n characters; null if empty."""
    said = F.trim(F.element_at(F.split(c, "</think>"), -1))
    said = F.regexp_replace(said, r"(?s)^```(.*)```$", "$1")
    return F.nullif(F.rtrim(F.substring(collapse(said), 1, n)), F.lit(""))


# Folders that are no part of a video's id, prefixes of its first part, endings of files.
FOLDERS = ("data", "raw", "videos", "keyframes", "video", "keyframe", "frames", "features", "images", "map-keyframes", "map_keyframes")
ENDINGS = ("mp4", "mkv", "avi", "mov", "webm", "jpg", "jpeg", "png", "webp", "csv")
PREFIX = "^(Videos_|Keyframes_)"


def _from_path(path: Column, prefixed: bool) -> tuple[Column, Column]:
    """"a.b.c" from a path's three parts from a prefixed one on, or its first three; and whether there are three."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & ~x.isin(*FOLDERS))
    named = F.array_position(F.transform(parts, lambda x: x.rlike(PREFIX)), True)
    start = F.when(named > 0, named.cast("int")) if prefixed else F.when(named > 0, named.cast("int")).otherwise(F.lit(1))
    a, b, c = (F.try_element_at(parts, start + i) for i in range(3))
    return F.concat_ws(".", F.regexp_replace(a, PREFIX, ""), b, F.regexp_replace(c, r"^(.+)\.[^.]+$", "$1")), c.isNotNull()


def video_id(given: Column, fallback: Column | None = None) -> Column:
    """A video's id as folder.group.number, from such an id, a path, or a file name of four parts; else from the path
    ``fallback`` if that is one of a video tree; else what is given, without its prefix."""
    fallback = F.lit(None).cast("string") if fallback is None else fallback
    c = F.coalesce(F.nullif(F.trim(given), F.lit("")), F.trim(fallback), F.lit(""))
    path = c.contains("/") | c.contains("\\")
    dots = F.split(c, r"\.")
    bare = F.regexp_replace(c, PREFIX, "")
    three, has_three = _from_path(c, False)
    other, has_other = _from_path(fallback, True)
    named = (F.size(dots) == 4) & F.lower(F.element_at(dots, -1)).isin(*ENDINGS)
    return (
        F.when((F.size(dots) == 3) & ~path, bare)
        .when(path & has_three, three)
        .when(named, F.regexp_replace(bare, r"\.[^.]*$", ""))
        .when(F.coalesce(has_other, F.lit(False)), other)
        .otherwise(bare)
    )


def is_integer(token: Column) -> Column:
    """Whether a JSON token is an integer: no string, fraction or boolean."""
    return token.rlike("^-?(0|[1-9][0-9]*)$")


def is_canonical(c: Column) -> Column:
    """Whether a string is as it should be stored: not empty, no white space around it."""
    return c.isNotNull() & (c != "") & (c == F.regexp_replace(c, r"^\s+|\s+$", ""))
