"""SQL over molecules: temporary views of a dataset, for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from molframe.operators.model import to_atoms, wide_atoms


def register(molecules: DataFrame, prefix: str = "") -> None:
    """Makes the views ``molecules`` and ``atoms`` (one row per atom, vectors as columns), with ``prefix`` before both names.

    Views are plans, not copies: what a query does not select is not read.
    """
    molecules.createOrReplaceTempView(f"{prefix}molecules")
    wide_atoms(to_atoms(molecules)).createOrReplaceTempView(f"{prefix}atoms")
