"""Reads statements up to their semicolons, runs them and prints what they give.

``python -m quernel.repl FOLDER [HOME [CATALOG]]`` reads standard input, over a folder of Parquet
tables or, with a text catalog, of delimited files. Made tables are kept in HOME.
"""

from __future__ import annotations

import sys
from typing import TextIO

from .session import Session


def statements(lines: TextIO):
    held = ""
    for line in lines:
        held += line
        while ";" in held:
            one, _, held = held.partition(";")
            if one.count("'") % 2:  # the semicolon is inside a string
                rest, found, after = held.partition(";")
                one, held = f"{one};{rest}", after
                if not found:
                    held = one
                    break
            if one.strip():
                yield one.strip() + ";"


def run(session: Session, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    """An error ends its statement only."""
    for statement in statements(lines):
        try:
            result = session.execute(statement)
            if result.plan:
                print(result.plan, file=out)
            if result.df is not None:
                n = 0
                for line in result.lines():
                    print(line, file=out)
                    n += 1
                print(f"OK, {n} rows returned", file=out)
            elif result.message:
                print(result.message, file=out)
            print(f"({result.seconds:.2f} secs)", file=out)
        except Exception as e:  # noqa: BLE001  whatever a statement raises, the next one is read
            print(f"error: {e}", file=out)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quernel").getOrCreate()
    folder, home, catalog = [*sys.argv[1:4], None, None][:3]
    session = Session(spark, home) if catalog else Session.of(spark, folder, home)
    if catalog:
        session.use_catalog(catalog, folder)
    run(session)
