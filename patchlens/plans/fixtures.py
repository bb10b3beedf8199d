"""Forms of source code, listings and patches that the given tables lack: each vendor fills them in, for Spark and as SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = """
a.o:     file format elf64-x86-64

Disassembly of section .init:

0000000000001000 <_init>:
    1000:\tf3 0f 1e fa \tendbr64

Disassembly of section .text:

0000000000001139 <parse_len>:
parse_len():
/root/__tmp/x/parse.c:10
int parse_len(const char *s, int n) {
    1139:\tf3 0f 1e fa \tendbr64
    113d:\t55 \tpush   rbp
    113e:\t48 89 e5 \tmov    rbp,rsp
    1141:\t48 89 7d e8 \tmov    QWORD PTR [rbp-0x18],rdi
    1145:\t89 75 e4 \tmov    DWORD PTR [rbp-0x1c],esi
/root/__tmp/x/parse.c:12
    /* checked */
    if (n > 0) {
    1148:\t83 7d e4 00 \tcmp    DWORD PTR [rbp-0x1c],0x0
    114c:\t7e 0a \tjle    1158 <parse_len+0x1f>
/root/__tmp/x/parse.c:13 (discriminator 2)
    114e:\t48 8b 45 e8 \tmov    rax,QWORD PTR [rbp-0x18]
    1152:\te8 d9 fe ff ff \tcall   1030 <strlen@plt>
    1157:\t90
    1158:\teb 05 \tjmp    short 115f <parse_len+0x26>
/root/__tmp/x/parse.c:14
        return 1; }
    115a:\tb8 01 00 00 00 \tmov    eax,0x1 ; one
    115f:\tc9 \tleave  # done
    1160:\tc3 \tret
...

0000000000001161 <helper>:
helper():
/usr/include/h.h:3
static int helper(void)
    1161:\t55 \tpush   rbp
    1162:\t5d \tpop    rbp
    1163:\tc3 \tret

0000000000001170 <parse_len.cold>:
parse_len():
/root/__tmp/x/parse.c:20
    1170:\t0f 0b \tud2
    1172:\t0f 0b \tud2
    1174:\t0f 0b \tud2

Disassembly of section .fini:

0000000000001200 <_fini>:
    1200:\tc3 \tret
"""
PATCHES = [
    (1, "@@ -1,3 +1,4 @@ int f(int a)\n a\n-b\n+c\n+d\n e\n@@ -10,1 +11,2 @@ void g()\n x\n+y"),
    (2, "@@ -5 +5 @@ no_commas(void)\n-q\n+r"),
    (3, "--- a/x.c\n+++ b/x.c\n@@ -7,2 +7,1 @@ static char *h (int z)\n-gone\n kept"),
    (4, "@@ -1,1 +1,1 @@ one @@ two\n-a\n+b"),
    (5, "no header at all"),
    (6, ""),
    (7, "@@ -1,0 +1,1 @@\n+only"),
]
ASM = [
    (1, "  1141:\t48 89 7d e8 \tmov    QWORD PTR [rbp-0x18],rdi"), (2, "  1157:\t90"), (3, "jle    1158 <parse_len+0x1f>"), (4, "CALL 1030 <strlen@plt>"), (5, "jmp short 115f <f+0x26>"),
    (6, "mov    eax, 0x1 ; one"), (7, "leave  # done"), (8, "js 10 <a+0x2>"), (9, ""), (10, "lea rax,[rip+0x2e] # 2010 <x>"), (11, "movsd  XMM0, qword ptr [rax]"), (12, "jae 44 <loop>"),
]
SOURCES = [
    (1, "int f(int a, char *b)\n{\n  /* note */\n  return g(a, \"x\\\"y\", 'c'); // end\n}"),
    (2, "void g(void) {\n}\n"),
    (3, "int h(const char *fmt, ...)\n{\n\tchar *s = \"/* not a comment */\";\n\tputs(s); /* a\n * b\n */\n\treturn 1 /* two */ + 2;\n}"),
    (4, "long k(int a, int b, int c, int d, int e, int f, int g) { return a; }"),
    (5, "* leading star\n*\n// only\n"),
    (6, ""),
    (7, "static int m()\n{\n    if (x) {\n        y();\n    }\n}"),
]
BINARY = [
    ("f", ["endbr64", "push rbp", "mov rbp,rsp", "mov DWORD PTR [rbp-4],edi", "mov QWORD PTR [rbp-16],rsi", "nop", "nop", "leave", "ret"]),
    ("g", ["push rbp", "ret"]),
    ("m", ["push rbp", "mov rbp,rsp", "mov QWORD PTR [rbp-8],0x0", "call 10 <y>", "pop rbp", "ret", "nop", "nop", "nop"]),
    ("other", ["push rbp", "mov rbp,rsp", "mov [rbp-4],edi", "mov [rbp-8],esi", "mov eax,0", "add eax,1", "mov [rbp-12],eax", "ret"]),
    ("__reserved", ["push rbp", "mov rbp,rsp", "mov [rbp-4],edi", "mov [rbp-8],esi", "nop", "nop", "nop", "ret"]),
    ("empty", []),
]


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]::varchar[]"
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A DuckDB table expression of the rows."""
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"


def filled(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """The rows once for each vendor, with its id as row_id and its name as own."""
    names = [x.split()[0] for x in schema.split(", ")]
    forms = F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in schema.split(', '))}>>")
    v = spark.read.parquet(f"{sf_dir}/vendors.parquet").filter("vendor_id is not null").select(F.col("vendor_id").alias("row_id"), F.coalesce("name", F.lit("")).alias("own"))
    return v.select("row_id", "own", F.inline(forms))


def filled_sql(rows: list[tuple], names: str) -> str:
    """`filled` as a DuckDB subquery."""
    return f"(SELECT v.vendor_id AS row_id, coalesce(v.name, '') AS own, t.* FROM vendors v, {values(rows, names)} WHERE v.vendor_id IS NOT NULL)"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each vendor, whose name stands in a comment of its source."""
    l = filled(spark, sf_dir, LISTING_ROWS, "binary string, line_no int, line string")
    return l.select(F.concat("binary", F.col("row_id").cast("string")).alias("binary"), "line_no", F.replace("line", F.lit("checked"), F.col("own")).alias("line"))


LISTING_ROWS = [("a.o", i, x) for i, x in enumerate(LISTING.split("\n"))]
LISTING_SQL = f"(SELECT bin || row_id AS bin, line_no, replace(line, 'checked', own) AS line FROM {filled_sql(LISTING_ROWS, 'bin, line_no, line')})"
