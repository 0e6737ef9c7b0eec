"""From raw documents to token files: language ID, n-gram Jaccard join, benchmark
decontamination, mixing sources to target weights, token-ID output.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame. ``ORACLE_SQL`` is None: the language model, the random mix and the token coder have
no SQL form. A test runs the stages over a whole small table instead and holds what each one
keeps of its own input against enumeration (groups, benchmark windows, sizes and targets, ids).
"""

from relsat.llm.pipeline import STAGES, run

ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
