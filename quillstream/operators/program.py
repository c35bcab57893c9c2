"""External programs as functions on columns (UDF-01 to UDF-03).

A program lives as long as its task: it is started once a partition, reads one
line a row and answers with one line, or gets a whole batch and answers once.
Its messages are kept apart and come up with the error if it fails.
"""

from __future__ import annotations

import subprocess
import threading
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a program's messages that an error shows.
SHOWN = 2_000


class ProgramError(RuntimeError):
    """A program ended early or answered with too few lines; its messages follow."""


class LineProgram:
    """A running program that answers every line with a line."""

    def __init__(self, command: Sequence[str]):
        self.command = list(command)
        self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, encoding="utf-8", bufsize=1)
        self._said: list[str] = []
        self._lock = threading.Lock()
        self._reader = threading.Thread(target=self._listen, daemon=True)
        self._reader.start()

    def _listen(self) -> None:
        for line in self.process.stderr:
            with self._lock:
                self._said.append(line)

    def messages(self) -> str:
        with self._lock:
            return "".join(self._said)[-SHOWN:]

    def ask(self, line: str) -> str:
        try:
            self.process.stdin.write(line.replace("\r", " ").replace("\n", " ") + "\n")
            self.process.stdin.flush()
            answer = self.process.stdout.readline()
        except BrokenPipeError:
            answer = ""
        if not answer:
            self.process.wait()
            self._reader.join(5)
            raise ProgramError(f"{self.command[0]} ended with {self.process.returncode}: {self.messages()}")
        return answer.rstrip("\n")

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait()
        self._reader.join(5)
        self.process.stdout.close()
        self.process.stderr.close()


def answered_lines(df: DataFrame, column: str, command: Sequence[str], out: str = "answer") -> DataFrame:
    """``df`` with ``out``: the program's answer to each value of a text column (UDF-01, UDF-02).

    Line breaks in a value are asked as blanks. NULL values aren't asked and
    stay NULL. A program that ends before its last answer fails the task with
    its messages.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    command = list(command)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = None
        for b in batches:
            program = program or LineProgram(command)
            answers = [None if x is None else program.ask(x) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string())], names=[*b.schema.names, out])
        if program:
            program.close()

    return df.mapInArrow(work, schema)


def answered_batches(df: DataFrame, column: str, command: Sequence[str], out: str = "answer") -> DataFrame:
    """The same by a program that reads a batch of lines to its end and then answers all of them (UDF-03)."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    command = list(command)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(column).to_pylist()
            text = "".join(x.replace("\r", " ").replace("\n", " ") + "\n" for x in asked if x is not None)
            done = subprocess.run(command, input=text, capture_output=True, text=True, encoding="utf-8", check=False)
            lines = done.stdout.split("\n")[:-1] if done.stdout.endswith("\n") else done.stdout.split("\n") if done.stdout else []
            if done.returncode or len(lines) != sum(x is not None for x in asked):
                raise ProgramError(f"{command[0]} ended with {done.returncode} after {len(lines)} lines: {done.stderr[-SHOWN:]}")
            answers = iter(lines)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else next(answers) for x in asked], pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(work, schema)


def in_program_form(df: DataFrame, *columns: str) -> DataFrame:
    """A JSON line a row of some columns, as programs read them."""
    return df.select("*", F.to_json(F.struct(*columns)).alias("line"))
