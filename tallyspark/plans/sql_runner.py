"""Runs files of SQL statements: python -m tallyspark.plans.sql_runner (FILE... | --all FOLDER) [--limit N]."""

from __future__ import annotations

import argparse
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Statements that give no rows to show.
_COMMAND = re.compile(r"\s*(COPY|CREATE|INSERT|DROP|ALTER|EXPLAIN|SET|USE)\b", re.I)
_COPY = re.compile(r"\s*COPY\s*\((.*)\)\s*TO\s*'([^']+)'\s*(?:\((.*)\))?\s*$", re.I | re.S)


def split_statements(sql: str) -> list[str]:
    """Cuts at semicolons outside quotes and comments; parts of comments alone are dropped."""
    out, start, i, code = [], 0, 0, False
    while i < len(sql):
        c = sql[i]
        if sql.startswith("--", i):
            end = sql.find("\n", i)
            i = len(sql) if end < 0 else end
            continue
        if sql.startswith("/*", i):
            end = sql.find("*/", i + 2)
            i = len(sql) if end < 0 else end + 2
            continue
        if c in "'\"`":
            end = sql.find(c, i + 1)
            i = len(sql) if end < 0 else end + 1
            code = True
            continue
        if c == ";":
            if code:
                out.append(sql[start:i].strip())
            start, code = i + 1, False
        elif not c.isspace():
            code = True
        i += 1
    if code:
        out.append(sql[start:].strip())
    return out


def _code(statement: str) -> str:
    return re.sub(r"\A(\s*--[^\n]*\n|\s*/\*.*?\*/)*", "", statement + "\n", flags=re.S).strip()


def is_query(statement: str) -> bool:
    return not _COMMAND.match(_code(statement))


#: Forms of other dialects and what Spark calls them; view definitions become temporary, so that they may stand on temporary views.
_FORMS = [
    (re.compile(r"\bread_parquet\s*\(\s*'([^']+)'\s*\)", re.I), r"parquet.`\1`"),
    (re.compile(r"\bread_csv(?:_auto)?\s*\(\s*'([^']+)'\s*\)", re.I), r"csv.`\1`"),
    (re.compile(r"\bCREATE\s+(?:OR\s+REPLACE\s+)?VIEW\b", re.I), "CREATE OR REPLACE TEMPORARY VIEW"),
    (re.compile(r"\*\s*EXCLUDE\s*\(", re.I), "* EXCEPT ("),
]


def translated(statement: str) -> str:
    """A statement with forms that Spark names otherwise put in its words; strings and comments stay."""
    parts = re.split(r"(--[^\n]*|/\*.*?\*/)", statement, flags=re.S)
    for form, words in _FORMS:
        parts[::2] = [form.sub(words, p) for p in parts[::2]]
    return "".join(parts)


_BY_NAME = re.compile(r"\bUNION\s+ALL\s+BY\s+NAME\b", re.I)
_HIDDEN = re.compile(r"--[^\n]*|/\*.*?\*/|'[^']*'|\"[^\"]*\"|`[^`]*`", re.S)


def by_position(statement: str, columns_of) -> str:
    """UNION ALL BY NAME as unions by position: columns in the order of their first part, NULL where a part lacks one.

    columns_of names the columns of a part, which must stand by itself.  An
    ORDER BY after the last part sorts the whole union.
    """
    while True:
        plain = _HIDDEN.sub(lambda m: " " * len(m[0]), statement)
        found = list(_BY_NAME.finditer(plain))
        if not found:
            return statement
        # the innermost scope that holds the last of them
        depth, start = 0, found[-1].start()
        while start > 0 and depth >= 0:
            start -= 1
            depth += {")": 1, "(": -1}.get(plain[start], 0)
        start += depth < 0
        depth, end = 0, found[-1].end()
        while end < len(plain) and depth >= 0:
            depth += {"(": 1, ")": -1}.get(plain[end], 0)
            end += 1
        end -= depth < 0
        cuts, at = [], start
        inner = lambda i: plain.count("(", start, i) == plain.count(")", start, i)
        for m in found:
            if start <= m.start() < end and inner(m.start()):
                cuts.append(statement[at : m.start()])
                at = m.end()
        last = [m.start() for m in re.finditer(r"\bORDER\s+BY\b", plain, re.I) if at <= m.start() < end and inner(m.start())]
        until = last[0] if last else end
        parts = [*cuts, statement[at:until]]
        has = [columns_of(_code(p)) for p in parts]
        names = list(dict.fromkeys(c for cols in has for c in cols))
        picked = [", ".join(f"`{c}`" if c in cols else f"NULL AS `{c}`" for c in names) for cols in has]
        union = " UNION ALL ".join(f"SELECT {cols} FROM ({_code(p)}\n)" for cols, p in zip(picked, parts))
        statement = f"{statement[:start]}{union} {statement[until:end]}{statement[end:]}"


def label(statement: str, width: int = 65) -> str:
    """The first words of the comment before a statement."""
    for line in statement.splitlines():
        line = line.strip()
        if not line.startswith("--"):
            break
        text = line.strip("-= \t")
        if text:
            return text if len(text) <= width else text[: width - 3] + "..."
    return ""


def rendered(rows: list[tuple], columns: list[str], more: int = 0) -> str:
    cells = [["NULL" if v is None else str(v) for v in r] for r in rows]
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, widths))
    return "\n".join([line(columns), "-+-".join("-" * w for w in widths), *map(line, cells), *([f"... {more} more rows"] if more else [])])


@dataclass
class Result:
    label: str
    query: bool
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    total: int = 0
    error: str = ""


def run_sql(spark: SparkSession, sql: str, limit: int = 20) -> list[Result]:
    """Runs each statement; an error is kept with its statement and the rest goes on."""
    out = []
    for statement in split_statements(sql):
        result = Result(label(statement), is_query(statement))
        out.append(result)
        try:
            statement = by_position(translated(statement), lambda part: spark.sql(part).columns)
            copy = _COPY.match(_code(statement))
            if copy:
                options = dict(re.findall(r"(\w+)\s+(\w+)", copy[3] or ""))
                kind = options.get("FORMAT", "PARQUET").lower()
                spark.sql(copy[1]).write.mode("overwrite").format(kind).option("compression", options.get("COMPRESSION", "snappy").lower()).save(copy[2])
            elif result.query:
                df = spark.sql(statement)
                result.columns = df.columns
                result.rows = [tuple(r) for r in df.limit(limit).collect()]
                result.total = len(result.rows) if len(result.rows) < limit else df.count()
            else:
                spark.sql(statement)
        except Exception as e:
            result.error = str(e).split("\n")[0]
    return out


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("files", nargs="*")
    parser.add_argument("--all", metavar="FOLDER", help="run the folder's .sql files in the order of their names")
    parser.add_argument("--limit", type=int, default=20)
    args = parser.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = sorted(os.path.join(args.all, f) for f in os.listdir(args.all) if f.endswith(".sql")) if args.all else []
    for path in [*args.files, *found]:
        with open(path, encoding="utf-8") as f:
            for r in run_sql(spark, f.read(), args.limit):
                print(f"\n{r.label}\n" + (f"[skipped: {r.error}]" if r.error else rendered(r.rows, r.columns, r.total - len(r.rows)) if r.query else ""))


if __name__ == "__main__":
    main()
