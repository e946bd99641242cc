"""Letters of sequences: types, composition, neighbour bonds and possible type pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Letter codes, nucleotide codes, residue classes.
PROTEIN_TYPES = {
    "M": 1, "G": 2, "K": 3, "T": 4, "R": 5, "A": 6, "D": 7, "E": 8, "Y": 9, "V": 10,
    "I": 11, "Q": 12, "W": 13, "F": 14, "S": 15, "H": 16, "N": 17, "P": 18, "C": 19, "L": 20,
}
RNA_TYPES = {"A": 21, "C": 22, "G": 23, "U": 24}
RNA_TYPES_ALTERNATIVE = {"A": 21, "C": 22, "U": 23, "G": 24}
RESIDUE_CLASSES = {"Electrostatic": "RHKDE", "Polar": "STNQ", "Hydrophobic": "CGPAVILM", "Aromatic": "FYW"}
NUCLEOTIDES = "AUCG"


def cleaned(text: Column, is_rna: Column) -> Column:
    """Letters only, upper case; T becomes U in RNA."""
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(is_rna, F.translate(letters, "T", "U")).otherwise(letters)


def letter_type(letter: Column, is_rna: Column, rna_types: dict[str, int] = RNA_TYPES) -> Column:
    def lookup(table: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[letter]

    return F.when(is_rna, lookup(rna_types)).otherwise(lookup(PROTEIN_TYPES))


def residue_class(letter: Column) -> Column:
    out = F.lit("Nucleotide")
    for name, letters in RESIDUE_CLASSES.items():
        out = F.when(letter.isin(*letters), name).otherwise(out)
    return out


def positions(sequences: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """One row per letter with its 0-based position."""
    return sequences.select(*keys, F.posexplode(F.split(seq, "")).alias("position", "letter"))


def composition(sequences: DataFrame, keys: Sequence[str], seq: str, is_rna: str) -> DataFrame:
    """Counts over the fixed letter sets, zero where a letter is absent.

    Each letter is counted inside its row by comparing lengths, so no text is exploded.
    """
    def counted(letters: str) -> list[Column]:
        return [F.struct(F.lit(c).alias("letter"), (F.length(seq) - F.length(F.replace(F.col(seq), F.lit(c), F.lit("")))).cast("long").alias("n")) for c in letters]

    protein = F.array(*counted("".join(RESIDUE_CLASSES.values())))
    rna = F.array(*counted(NUCLEOTIDES))
    rows = sequences.select(*keys, is_rna, F.explode(F.when(F.col(is_rna), rna).otherwise(protein)).alias("c"))
    out = rows.groupBy(*keys, is_rna, F.col("c.letter").alias("letter")).agg(F.sum("c.n").alias("count"))
    return out.withColumn("residue_class", F.when(F.col(is_rna), "Nucleotide").otherwise(residue_class(F.col("letter"))))


def bonds(sequences: DataFrame, keys: Sequence[str], seq: str, reach: Column, weight: Column) -> DataFrame:
    """Letter pairs up to ``reach`` positions apart, weighted by copy number: (keys, a, b, count), a <= b.

    Whole sequences are counted as arrays of letter codes inside the tasks. A batch gives
    at most one row per sequence key and letter pair, so little is left to shuffle.
    """
    names = list(keys)
    rows = sequences.select(*names, F.col(seq).alias("_seq"), reach.cast("int").alias("_reach"), weight.cast("long").alias("_w"))
    schema = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in names) + "a string, b string, count long"

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            totals: dict[tuple, np.ndarray] = {}
            for row in pdf.itertuples(index=False):
                letters = np.frombuffer(row[len(names)].encode("ascii"), np.uint8).astype(np.int64) - 65
                sums = totals.setdefault(tuple(row[: len(names)]), np.zeros(26 * 26, np.int64))
                for k in range(1, min(row[len(names) + 1], len(letters) - 1) + 1):
                    x, y = letters[:-k], letters[k:]
                    sums += row[len(names) + 2] * np.bincount(np.minimum(x, y) * 26 + np.maximum(x, y), minlength=26 * 26)
            for key, sums in totals.items():
                hit = np.flatnonzero(sums)
                out = pd.DataFrame({"a": [chr(65 + h // 26) for h in hit], "b": [chr(65 + h % 26) for h in hit], "count": sums[hit]})
                for name, value in zip(names, key):
                    out[name] = value
                yield out[[*names, "a", "b", "count"]]

    return rows.mapInPandas(counted, schema).groupBy(*names, "a", "b").agg(F.sum("count").alias("count"))


def type_pairs_by_filter(counts: DataFrame, molecule: str, item: str, n: str, copies: str, bonded: DataFrame) -> DataFrame:
    """Possible type pairs: all, inter, intra, without the bonded pairs of the same chain.

    ``counts``: letters per molecule with copy numbers; ``bonded``: (a, b, count) already
    weighted by copies. all = total - bonded, inter = total - same chain, intra = same
    chain - bonded. Tables here have one row per molecule and type.
    """
    total = counts.groupBy(F.col(item).alias("t")).agg(F.sum(F.col(n) * F.col(copies)).cast("double").alias("n"))
    left, right = total.select(F.col("t").alias("a"), F.col("n").alias("_x")), total.select(F.col("t").alias("b"), F.col("n").alias("_y"))
    same = F.col("a") == F.col("b")
    every = left.join(F.broadcast(right), F.col("a") <= F.col("b")).select(
        "a", "b", F.when(same, F.col("_x") * F.greatest(F.col("_x") - 1, F.lit(0.0)) / 2).otherwise(F.col("_x") * F.col("_y")).alias("n_total")
    )
    mine = counts.select(molecule, copies, F.col(item).alias("a"), F.col(n).cast("double").alias("_x"))
    other = counts.select(molecule, F.col(item).alias("b"), F.col(n).cast("double").alias("_y"))
    chain = mine.join(other, molecule).filter("a <= b")
    per_chain = F.when(same, F.col("_x") * F.greatest(F.col("_x") - 1, F.lit(0.0)) / 2).otherwise(F.col("_x") * F.col("_y"))
    intra = chain.groupBy("a", "b").agg(F.sum(F.col(copies) * per_chain).alias("n_chain"))
    out = every.join(intra, ["a", "b"], "left").join(bonded.select("a", "b", F.col("count").alias("n_bonded")), ["a", "b"], "left").fillna(0, ["n_chain", "n_bonded"])
    return out.select("a", "b", (F.col("n_total") - F.col("n_bonded")).alias("n_all"), (F.col("n_total") - F.col("n_chain")).alias("n_inter"), (F.col("n_chain") - F.col("n_bonded")).alias("n_intra"))
