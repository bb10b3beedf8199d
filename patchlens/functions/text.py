"""Source, assembly and diff text as Column expressions. All of it runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of disassembly and C text, down to NOT_COMMENT.
SIZE_MARKER = r"\b(byte|word|dword|qword|tword|short)\s+ptr\b"
MEMORY = r"\[[^\]]+\]"
JUMP = r"\b(j(mp|e|z|nz|ne|g|ge|l|le|b|be|a|ae))\s+(short\s+)?[0-9a-f]+\s+<[^>]+>"
CALL = r"\bcall\s+[0-9a-f]+\s+<([^>]+)>"
LABEL_OFFSET = r"<([^+]+)\+\S+>"
PARAMETER_STORES = ("mov <MEM>", "movsd <MEM>", "movss <MEM>")
ZERO_STORE = "mov <MEM>,0x0"
MOST_PARAMETERS = 6
#: A block comment, or (group 1) a string, a character literal or other text. Possessive: literals of any length don't recurse.
NOT_COMMENT = r"""(?s)/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/|("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|.[^/"'\\]*+)"""


def let(value: Column, body) -> Column:
    """`body(value)`, the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tail(a: Column, start) -> Column:
    """The array from 0-based `start` on."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.slice(a, start + 1, F.greatest(F.size(a) - start, F.lit(0)))


def normalize_asm(line: Column) -> Column:
    """One instruction in canonical form; null for a raw listing line without exactly three tab parts.

    Comments go; memory operands become <MEM>, targets of common jumps <LOC>,
    calls keep their symbol, offsets of labels become OFFSET.
    """
    parts = F.split(line, "\t")
    code = F.when(F.instr(line, "\t") == 0, line).when(F.size(parts) == 3, F.element_at(parts, -1))
    c = F.substring_index(F.regexp_replace(F.lower(code), ";.*", ""), "#", 1)
    c = strip(F.regexp_replace(c, r"\s+", " "))
    c = F.regexp_replace(F.regexp_replace(c, SIZE_MARKER, ""), MEMORY, "<MEM>")
    c = F.regexp_replace(F.regexp_replace(c, JUMP, "$1 <LOC>"), CALL, "call <$1>")
    c = F.regexp_replace(F.replace(c, F.lit(" short "), F.lit(" ")), LABEL_OFFSET, "<$1+OFFSET>")
    return F.replace(F.replace(c, F.lit("  "), F.lit(" ")), F.lit(", "), F.lit(","))


def normalize_asm_lines(lines: Column) -> Column:
    return F.filter(F.transform(lines, normalize_asm), lambda x: x.isNotNull() & (x != ""))


def remove_comments(text: Column) -> Column:
    """Text without block comments; literals are kept whole, line comments stay."""
    return F.array_join(F.regexp_extract_all(text, F.lit(NOT_COMMENT), F.lit(1)), "")


def is_comment_line(line: Column) -> Column:
    return line.rlike(r"^(/\*|\* |//)") | line.endswith("*/") | line.isin("", "*")


def normalize_src_lines(lines: Column) -> Column:
    """Source lines without comment and blank lines, literals replaced, blanks squeezed."""
    kept = F.filter(F.transform(lines, strip), lambda x: ~is_comment_line(x))

    def one(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r'".*?"', '"STR"'), r"\t+", " ")
        return remove_comments(F.regexp_replace(x, " +", " "))

    return F.transform(kept, one)


def normalize_strings(strings: Column) -> Column:
    """Distinct literals of at least four characters, trimmed, a written-out line feed at the end removed; sorted."""
    cleaned = F.transform(strings, lambda s: F.regexp_replace(strip(s), r"\\n$", ""))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda s: F.char_length(s) >= 4)))


def first_index(lines: Column, has) -> Column:
    """0-based place of the first element for which `has` holds, else null."""
    at = F.filter(F.transform(lines, lambda x, i: F.when(has(x), i)), lambda i: i.isNotNull())
    return F.get(at, 0)


def brace_index(lines: Column) -> Column:
    """Place of the first line with an opening brace, 0 if none."""
    return F.coalesce(first_index(lines, lambda x: F.contains(x, F.lit("{"))), F.lit(0))


def effective_line_count(lines: Column) -> Column:
    """Normalised lines from the first brace on that have two tokens or more than ten characters."""

    def count(n: Column) -> Column:
        weighty = lambda x: (F.size(F.split(strip(x), r"\s+")) > 1) | (F.char_length(strip(x)) > 10)
        return F.size(F.filter(tail(n, brace_index(n)), weighty))

    return let(normalize_src_lines(lines), count)


def source_header(lines: Column) -> Column:
    """Struct of normalised source: body_start and param_count (six at most, variadic counts as six)."""
    start = brace_index(lines) + 1
    inside = F.substring_index(F.substring_index(F.array_join(F.slice(lines, F.lit(1), start), " "), "(", -1), ")", 1)
    n = F.when(inside.isin("void", ""), 0).when(inside.endswith("..."), MOST_PARAMETERS).otherwise(F.regexp_count(inside, F.lit(",")) + 1)
    return F.struct(start.alias("body_start"), F.least(n, F.lit(MOST_PARAMETERS)).alias("param_count"))


def asm_prologue(lines: Column) -> Column:
    """Struct of normalised assembly: body_start and param_count from the first run of stores among lines 1 to 19."""
    store = lambda x: F.substring_index(x, ",", 1).isin(*PARAMETER_STORES) & (x != ZERO_STORE)
    numbered = F.transform(F.slice(lines, 2, 19), lambda x, i: F.struct(store(x).alias("s"), i.alias("i")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(1).alias("body"), F.lit(False).alias("over"))

    def step(a: Column, x: Column) -> Column:
        hit = x["s"] & ~a["over"]
        return F.struct((a["n"] + hit.cast("int")).alias("n"), F.when(hit, x["i"] + 2).otherwise(a["body"]).alias("body"), (a["over"] | (~x["s"] & (a["n"] > 0))).alias("over"))

    return F.aggregate(numbered, zero, step, lambda a: F.struct(a["body"].alias("body_start"), F.least(a["n"], F.lit(MOST_PARAMETERS)).alias("param_count")))


def strip_sign(line: Column) -> Column:
    return F.regexp_replace(line, "^[+-]", "")


def strip_pointer(name: Column) -> Column:
    return F.regexp_replace(name, r"^\*", "")


def source_body(lines: Column) -> Column:
    """Lines after the first with an opening brace, without any further line that has one."""
    has = lambda x: F.contains(x, F.lit("{"))
    first = first_index(lines, has)
    return F.filter(lines, lambda x, i: (i > F.coalesce(first, F.size(lines))) & ~has(x))


def snippet_text(lines: Column) -> Column:
    """Diff lines without signs, blank lines and comments, joined by spaces."""
    return remove_comments(F.array_join(F.filter(F.transform(lines, lambda x: strip(strip_sign(x))), lambda x: x != ""), " "))


def answer_span(context: Column, answer: Column) -> Column:
    """Struct start, end of the first occurrence; start is -1 if there is none, 0 for an empty answer."""
    start = F.call_function("instr", context, answer) - 1
    return F.struct(start.alias("start"), (start + F.char_length(answer) - 1).alias("end"))


def first_difference(a: Column, b: Column) -> Column:
    """0-based place of the first difference; 0 if the shorter list is a beginning of the other."""
    n = F.least(F.size(a), F.size(b))

    def place(x: Column, y: Column) -> Column:
        differ = F.filter(F.transform(F.slice(x, F.lit(1), n), lambda e, i: F.when(e != F.get(y, i), i)), lambda i: i.isNotNull())
        return F.coalesce(F.get(differ, 0), F.lit(0))

    return let(a, lambda x: let(b, lambda y: place(x, y)))


def last_difference(a: Column, b: Column) -> Column:
    """How many elements at the ends are equal: the last difference is before them; 0 if the shorter list is an end of the other."""
    return first_difference(F.reverse(a), F.reverse(b))


def choice_texts(a: Column, b: Column, lines: int = 10) -> Column:
    """Both lists' `lines` from their first difference on, joined, without comments."""
    at = first_difference(a, b)
    part = lambda x: remove_comments(F.array_join(F.slice(x, at + 1, lines), " "))
    return F.struct(part(a).alias("text_0"), part(b).alias("text_1"))


def content_hash(text: Column) -> Column:
    """md5 of the text in lower case without braces and white space."""
    return F.md5(F.lower(F.translate(text, "\n\r\t{} ", "")))


def function_of_context(context: Column) -> Column:
    """A function's name from a hunk's context: the last token before `(` among its first three."""
    head = F.array_join(F.slice(F.split(strip(context), r"\s+"), 1, 3), " ")
    return F.when(F.contains(head, F.lit("(")), F.element_at(F.split(strip(F.substring_index(head, "(", 1)), r"\s+"), -1))


def owner_and_repo(url: Column) -> Column:
    p = F.split(url, "/")
    return F.struct(F.get(p, 3).alias("owner"), F.get(p, 4).alias("repo"))


def url_query(url: Column, key: str) -> Column:
    """A value of a query whose pairs are separated by `&` or `;`."""
    query = F.replace(F.substring_index(F.regexp_extract(url, r"\?(.*)$", 1), "#", 1), F.lit(";"), F.lit("&"))
    return F.nullif(F.regexp_extract(query, f"(?:^|&){key}=([^&]*)", 1), F.lit(""))


def file_and_function(path: Column) -> Column:
    """Struct file, function from `<file>.c_<function>` or `.h_`; null unless there is exactly one separator."""
    one = F.regexp_count(path, F.lit(r"\.[ch]_")) == 1
    get = lambda k: F.when(one, F.regexp_extract(path, r"^(.*\.[ch])_(.*)$", k))
    return F.struct(get(1).alias("file"), get(2).alias("function"))


def node_name(text: Column) -> Column:
    return F.replace(F.substring_index(text, "(", 1), F.lit("* "), F.lit(""))


def is_reserved(name: Column) -> Column:
    """Identifiers reserved in C: underscore and capital, or two underscores anywhere."""
    return name.rlike("^_[A-Z]|__")


def sliding_windows(items: Column, length: int = 70, step: int = 20) -> Column:
    """Windows of `length` every `step`; a shorter list is one; a rest at the end is covered by a window at the end."""

    def cut(a: Column) -> Column:
        n = F.size(a)
        regular = F.transform(F.sequence(F.lit(0), F.floor((n - length) / step).cast("int")), lambda k: F.slice(a, k * step + 1, length))
        rest = F.when((n - length) % step != 0, F.array(F.slice(a, n - length + 1, length))).otherwise(F.slice(F.array(a), 1, 0))
        return F.when(n <= length, F.array(a)).otherwise(F.concat(regular, rest))

    return let(items, cut)


def text_windows(text: Column, length: int = 30, step: int = 20) -> Column:
    """As sliding_windows, over the characters of a text, in one pass; `step` is at most `length`."""
    n = F.char_length(text)
    regular = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}})).{{{step}}}"), F.lit(1))
    rest = F.when((n - length) % step != 0, F.array(F.right(text, F.lit(length)))).otherwise(F.array().cast("array<string>"))
    return F.when(n <= length, F.array(text)).otherwise(F.concat(regular, rest))


def locate_suffix(lines: Column, text: Column, length: int = 30) -> Column:
    """`length` lines from the last place from which the joined rest still holds `text`; empty if none does."""

    def found(a: Column) -> Column:
        joined = F.array_join(a, " ")
        # a place is where a line starts in the joined text; the last one at or before the last occurrence of `text`
        sizes = F.transform(a, lambda x: F.char_length(x) + 1)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(sizes, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
        occurrence = F.char_length(joined) - F.char_length(text) - F.call_function("instr", F.reverse(joined), F.reverse(text)) + 1
        last = F.greatest(F.size(F.filter(starts, lambda s: s <= occurrence)) - 1, F.lit(0))
        return F.when(~F.contains(joined, text), F.slice(a, 1, 0)).otherwise(F.slice(a, last + 1, length))

    return let(lines, found)


def prompt(source: Column, patch: Column, assembly: Column) -> Column:
    """A question about one function, its patch and a disassembly, as JSON."""
    return F.to_json(F.struct(F.lit("Does the binary function contain the patch? Answer yes or no.").alias("question"), F.array_join(normalize_src_lines(source), "\n").alias("source"), patch.alias("patch"), F.array_join(normalize_asm_lines(assembly), "\n").alias("assembly")))


def trimmed_record(df, numeric: dict[str, str] = {}):  # noqa: B006
    """All string columns stripped; the named ones cast, with empty, zero and unreadable values as null."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in numeric:
            c = F.nullif(strip(c.cast("string")).try_cast(numeric[name]), F.lit(0).cast(numeric[name]))
        elif kind == "string":
            c = strip(c)
        out.append(c.alias(name))
    return df.select(*out)


def arg_max_label(scores: Column) -> Column:
    """Struct of an array of logits: label (0-based, the first of equals) and its softmax probability."""
    most = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - most))
    return F.struct((F.array_position(scores, most) - 1).cast("int").alias("label"), (F.lit(1.0) / total).alias("prob"))


def function_key(path: Column, name: Column) -> Column:
    """Path below the last `__tmp/`, without `./`, two underscores, name."""
    return F.concat(F.regexp_replace(F.substring_index(path, "__tmp/", -1), r"^\./", ""), F.lit("__"), name)


def line_position(text: Column) -> Column:
    """Struct path, line_number, is_discriminator of `path:line` or `path:line (discriminator n)`."""
    path, number = F.regexp_extract(text, r"^(.*):([^:]*)$", 1), F.regexp_extract(text, r"^(.*):([^:]*)$", 2)
    return F.struct(path.alias("path"), F.substring_index(F.trim(number), " ", 1).try_cast("int").alias("line_number"), F.contains(F.trim(number), F.lit(" ")).alias("is_discriminator"))
