"""Order-dependent steps within one read: chain filter, region dedup, primary marking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandline.align.regions import mixed

MASK, DROP, GAP, SEED, CAP = 0.5, 0.5, 10_000, 19, 1 << 30


def filtered_chains(chains: DataFrame, key: str = "doc_id", mask: float = MASK, drop: float = DROP, gap: int = GAP, seed: int = SEED) -> DataFrame:
    """(key, qbeg, qend, w, kept) of the chains kept: 3 clear, 2 overlapping, 1 promoted as first shadowed.

    Chains come by weight, then by place, so ties are stable. A chain falls if a
    kept one covers ``mask`` of the shorter and outweighs it by ``drop`` and by
    two seeds. One read's chains are bounded by its length.
    """
    f32 = np.float32

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["w", "qbeg", "qend"], ascending=[False, True, True]).reset_index(drop=True)
        b, e, w = g["qbeg"].to_numpy(), g["qend"].to_numpy(), g["w"].to_numpy()
        kept, first, stays = np.zeros(len(g), int), {}, []
        for i in range(len(g)):
            shadow = False
            for j in stays:
                shorter = min(e[i] - b[i], e[j] - b[j])
                common = min(e[i], e[j]) - max(b[i], b[j])
                if common > 0 and f32(common) >= f32(shorter) * f32(mask) and shorter < gap:
                    shadow = True
                    first.setdefault(j, i)
                    if f32(w[i]) < f32(w[j]) * f32(drop) and w[j] - w[i] >= 2 * seed:
                        break
            else:
                stays.append(i)
                kept[i] = 2 if shadow else 3
        for i in first.values():
            kept[i] = max(kept[i], 1) if kept[i] != 3 else 3
        return g.assign(kept=kept)[kept > 0][[key, "qbeg", "qend", "w", "kept"]]

    return chains.groupBy(key).applyInPandas(run, f"{key} long, qbeg long, qend long, w long, kept long")


def marked_primary(regions: DataFrame, key: str = "doc_id", mask: float = MASK, near: int = 7) -> DataFrame:
    """(key, item_id, qbeg, qend, score, secondary, sub, sub_n): secondary is null for primaries, else its primary's rank."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["item_id", "rbeg", "qbeg"]).reset_index(drop=True)
        g["tie"] = [mixed(int(g[key].iloc[0]) + i) for i in range(len(g))]
        g = g.sort_values(["score", "tie"], ascending=[False, True]).reset_index(drop=True)
        sub, sub_n, secondary, heads = [0] * len(g), [0] * len(g), [None] * len(g), []
        b, e, s = g["qbeg"].tolist(), g["qend"].tolist(), g["score"].tolist()
        for i in range(len(g)):
            for j in heads:
                common = min(e[i], e[j]) - max(b[i], b[j])
                if common > 0 and common >= mask * min(e[i] - b[i], e[j] - b[j]):
                    sub[j] = sub[j] or s[i]
                    sub_n[j] += s[j] - s[i] <= near
                    secondary[i] = j
                    break
            else:
                heads.append(i)
        return g.assign(sub=sub, sub_n=sub_n, secondary=pd.array(secondary, "Int64"))[[key, "item_id", "qbeg", "qend", "score", "secondary", "sub", "sub_n"]]

    return regions.groupBy(key).applyInPandas(run, f"{key} long, item_id long, qbeg long, qend long, score long, secondary long, sub long, sub_n long")
