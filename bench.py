"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terralane.plans import catalog  # noqa: E402
from terralane.session import local_session  # noqa: E402

HEADLINE = [
    "nearest_join_j3", "knn_join_j4", "spatial_join_j1", "spatial_join_stats_j2", "spatial_join_features_j1",
    "within_distance_join_j5", "proximity_outside_p4", "map_match_j9", "reproject_utm_p5", "measure_length_p9",
    "simplify_layer_p11", "overlay_intersection_exact_o1", "overlay_union_o2", "dissolve_o7", "convex_hull_o9",
    "density_grid_a7", "raster_stats_a4", "zonal_stats_a5", "ndvi_r8", "all_indices_r10", "change_detection_r11",
    "slope_r18", "hillshade_r20", "flow_accumulation_r29", "contour_r17", "fill_nodata_r16", "morans_i_t1",
    "getis_ord_t3", "idw_t5", "kde_t9", "constrain_area_t14", "shortest_path_n3", "service_area_n6",
    "closest_facility_n7", "cost_distance_n10", "bm25_x1", "cosine_topk_x2", "split_sections_x5",
]


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    times: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(found.group(1)) if found else None}))


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
