"""Log loss, recall and false share of the toxicity model by folds of the training rows.

``python tests/llm/toxicity_folds.py SF_DIR`` fits on three of the four folds (crc32 of the id mod 5 in 1 to 4) and scores
the fourth, for some lengths of runs and numbers of landmarks. Held-out documents (0) are dropped before anything is read from them.
"""

import os

os.environ["OPENBLAS_NUM_THREADS"] = "1"

import sys
import zlib
from multiprocessing import Pool
from pathlib import Path

import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from feira.llm import toxicity

CHOICES = [(3, 700), (3, 350), (3, 1000), (2, 700), (4, 700), (6, 700)]


def training_rows(folder: str) -> pd.DataFrame:
    docs = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    labels = pd.read_parquet(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).dropna().groupby("doc_id", as_index=False).max()
    rows = docs.merge(labels, on="doc_id").sort_values("doc_id")
    rows["fold"] = [zlib.crc32(str(i).encode()) % 5 for i in rows["doc_id"]]
    return rows[rows["fold"] != 0]


def scored(choice: tuple) -> tuple:
    folder, words, landmarks, left_out = choice
    toxicity.WORDS, toxicity.LANDMARKS = words, landmarks
    rows = training_rows(folder)
    texts, toxic = [t or "" for t in rows["text"]], rows["toxic"].astype(int).to_numpy()
    fitted = (rows["fold"] != left_out).to_numpy()
    runs: tuple[set, set] = (set(), set())
    for i in np.flatnonzero(fitted):
        found = {run for part in toxicity._pieces(texts[i]) for run in toxicity.runs_of(part)}
        runs[toxic[i]].update(sorted(found, key=lambda run: (zlib.crc32(run), run))[: toxicity.RUNS[toxic[i]]])
    model = toxicity.Model(*toxicity._fit_runs(sorted(runs[1]), sorted(runs[0])), np.zeros(0), 0.5)
    x = toxicity._inputs(model.features(texts))
    model.head = toxicity.fit_logistic(x[fitted], toxic[fitted].astype(float), np.ones(fitted.sum()))
    p, y = toxicity._probability(x[~fitted], model.head), toxic[~fitted]
    loss = -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-6, 1)).mean()
    return words, landmarks, left_out, loss, (p[y == 1] >= 0.5).mean(), (p[y == 0] >= 0.5).mean()


if __name__ == "__main__":
    jobs = [(sys.argv[1], *choice, fold) for choice in CHOICES for fold in (1, 2, 3, 4)]
    with Pool() as pool:
        table = pd.DataFrame(pool.map(scored, jobs, chunksize=1), columns=["words", "landmarks", "fold", "loss", "recall", "false"])
    print(table.round(4).to_string(index=False))
    print(table.groupby(["words", "landmarks"])[["loss", "recall", "false"]].mean().round(4))
