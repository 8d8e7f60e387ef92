"""Pinned blobs of local git repositories, many at once."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def pinned_blobs(paths: DataFrame, root: str, content: bool = False) -> DataFrame:
    """(repo_path, source_sha, path, blob_sha, content): the blob of each path at its commit; null where git has none.

    One git process a repository, task and batch; paths are distinct first. ``root``
    must be readable on every executor.
    """

    def git(repo: str, what: str, names: list[str]) -> bytes:
        r = subprocess.run(["git", "-C", f"{root}/{repo}", "cat-file", what], input="".join(f"{n}\n" for n in names).encode(), capture_output=True, check=False)
        return r.stdout if r.returncode == 0 else b""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for repo, g in b.groupby("repo_path", sort=True):
                names = [f"{s}:{p}" for s, p in zip(g["source_sha"], g["path"])]
                lines = git(repo, "--batch-check=%(objectname) %(objecttype)", names).decode().splitlines()
                shas = [x.split(" ")[0] if x.endswith(" blob") else None for x in lines] + [None] * (len(names) - len(lines))
                texts: list[str | None] = [None] * len(names)
                if content:
                    raw, at = git(repo, "--batch=%(objectsize)", [s for s in shas if s]), 0
                    for i, s in enumerate(shas):
                        if s:
                            end = raw.index(b"\n", at)
                            n = int(raw[at:end])
                            texts[i] = raw[end + 1 : end + 1 + n].decode("utf-8", "replace")
                            at = end + 2 + n
                yield pd.DataFrame({"repo_path": g["repo_path"].tolist(), "source_sha": g["source_sha"].tolist(), "path": g["path"].tolist(), "blob_sha": pd.Series(shas, dtype=object), "content": pd.Series(texts, dtype=object)})

    return paths.select("repo_path", "source_sha", "path").distinct().repartition("repo_path", "source_sha").mapInPandas(run, "repo_path string, source_sha string, path string, blob_sha string, content string")
