"""Session settings that plans depend on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the folder that spark.checkpoint.dir names, with a plan that begins there.

    Where the setting is absent, a local session (one machine) gets a temporary
    folder; on a cluster that is an error, since executors share no such folder.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="docwarden-")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)
