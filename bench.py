"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), and
BENCH_QUERIES ("all" or a comma list) select data, cores and queries.
"""

from __future__ import annotations

import json
import os
import time

from loomframe.plans import QUERIES
from loomframe.session import local_session

HEADLINE = (
    "text_filter_yield tag_split remark_split topic_rule word_split pad_truncate clean_text "
    "bpe_encode remap_filter_annotations relative_boxes images_with_n_objects "
    "annotations_by_image crop_overlap box_tokens flag_pack center_sequence box_sequence "
    "style_content_pairs shuffle_order exact_split epochs trailing_history ema nearest_code "
    "code_usage kmeans_iter codebook_ema cosine_pairs top_matches forward_noise "
    "topk_accuracy masked_loss channel_stats permute_roundtrip stitch_patches tiles ssim "
    "stream_filter_append stream_ema"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["text_filter_yield"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
