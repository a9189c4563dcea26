"""Binary files written by tasks into a folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``files(file, content)`` below ``folder``, each under its name; returns their number.

    A file is written under a temporary name and moved, so a task that is run again leaves whole files only. The folder may
    be any place the installed Arrow reaches: a path, ``file:``, ``hdfs:`` or ``s3:``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if ":/" in folder else "file://" + folder)
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"]):
                path = f"{root}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                unfinished = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                with store.open_output_stream(unfinished) as out:
                    out.write(bytes(content))
                store.move(unfinished, path)
            yield pd.DataFrame({"n": [len(batch)]})

    done = files.select("file", "content").mapInPandas(run, "n bigint").agg({"n": "sum"}).first()[0]
    return int(done or 0)
