"""Prompts with worked examples: instructions, numbered examples, a closing block; and the seeds of local runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def assembled(instructions: Column, examples: Column, closing: Column) -> Column:
    """Instructions, every example (``request``, ``answer``) in its order between marks, and the closing block, each part by a blank line.

    Without examples, instructions and closing alone. Versions of a prompt differ in what is passed, not in how it is put
    together.
    """
    block = lambda e, i: F.concat(F.lit("EXAMPLE "), (i + 1).cast("string"), F.lit("\nRequest: "), e["request"], F.lit("\nAnswer: "), e["answer"])
    shown = F.array_join(F.transform(examples, block), "\n\n")
    middle = F.when(F.size(examples) > 0, F.concat(F.lit("BEGIN EXAMPLES\n\n"), shown, F.lit("\n\nEND EXAMPLES\n\n"))).otherwise(F.lit(""))
    return F.concat(instructions, F.lit("\n\n"), middle, closing)


def local_seed(seed: Column) -> Column:
    """A 64-bit unsigned seed as one that a runtime with 31 bits takes."""
    return F.pmod(seed.cast("decimal(20,0)"), F.lit(2**31 - 1).cast("decimal(20,0)")).cast("long")
