import hashlib

MANIFEST = (
    "stage177_row_number long, image_path string, body_type string, color string, crop_quality string, viewpoint string, camera_id string, track_group string, source_group string, split string, "
    "annotation_source string, source_dataset string, reviewed_at_ms long, stage177_pixel_sha256 string, stage177_dhash64 string, stage177_exact_duplicate_of string, stage177_near_duplicate_of string, "
    "row long, side string, content string, v long, u long, m long, key string, set_id string, label string"
)
NAMES = [f.split()[0] for f in MANIFEST.split(", ")]


def manifest(spark, records):
    """Rows of the manifest from dicts; columns with the names that operators use inside hold noise."""
    noise = {"row": -7, "side": "x", "content": "zz", "v": 1, "u": 2, "m": 3, "key": "k", "set_id": "s", "label": "l"}
    data = [tuple(({"stage177_row_number": i} | noise | r).get(n) for n in NAMES) for i, r in enumerate(records, 1)]
    return spark.createDataFrame(data, MANIFEST)


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()
