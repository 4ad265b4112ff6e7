"""Admission of repository files, repository names, citations and address classes."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import bound

#: Path parts and names that are left out.
GENERATED_DIRECTORIES = (
    ".cache", ".git", ".gradle", ".idea", ".mypy_cache", ".next", ".nuxt", ".parcel-cache", ".pytest_cache", ".ruff_cache", ".svelte-kit", ".terraform", ".tox", ".venv", "__pycache__",
    "bower_components", "build", "coverage", "dist", "htmlcov", "jspm_packages", "node_modules", "obj", "out", "site-packages", "target", "venv",
)
VENDORED_DIRECTORIES = (
    "vendor", "vendored", "third_party", "thirdparty", "3rdparty", "pods", "external",
)
GENERATED_NAMES = (
    "cargo.lock", "composer.lock", "gemfile.lock", "go.sum", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock",
)
GENERATED_SUFFIXES = (
    ".min.js", ".min.css", ".js.map", ".css.map", ".bundle.js", ".generated.ts", "_pb2.py",
)
SECRET_NAMES = (
    ".dockercfg", ".git-credentials", ".htpasswd", ".netrc", ".npmrc", ".pgpass", ".pypirc", "credentials", "credentials.json", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa",
    "secrets.json", "secrets.yaml", "secrets.yml",
)
SECRET_EXTENSIONS = (
    ".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".ppk", ".kdbx",
)
TEMPLATE_SUFFIXES = (
    ".example", ".sample", ".template", ".dist", ".defaults",
)
BINARY_EXTENSIONS = (
    ".7z", ".a", ".ai", ".apk", ".avi", ".bin", ".bmp", ".bz2", ".class", ".ckpt", ".dat", ".db", ".dll", ".dmg", ".doc", ".docx", ".dylib", ".eot", ".exe", ".fig", ".flac", ".gif",
    ".gz", ".h5", ".ico", ".img", ".iso", ".jar", ".jpeg", ".jpg", ".mdb", ".mkv", ".mov", ".mp3", ".mp4", ".npy", ".npz", ".o", ".obj", ".ogg", ".onnx", ".otf", ".pb", ".pdb", ".pdf",
    ".png", ".ppt", ".pptx", ".psd", ".pt", ".pth", ".pyc", ".pyd", ".pyo", ".rar", ".safetensors", ".sketch", ".so", ".sqlite", ".sqlite3", ".tar", ".tgz", ".ttf", ".war", ".wasm",
    ".wav", ".webm", ".webp", ".whl", ".woff", ".woff2", ".xls", ".xlsx", ".xz", ".zip",
)
METADATA_ADDRESSES = ("169.254.169.254", "169.254.169.253", "169.254.170.2", "169.254.170.23", "100.100.100.200", "fd00:ec2::254")


def file_filter(entries: DataFrame, max_bytes: int = 512 * 1024) -> DataFrame:
    """Adds reason (null: admitted) to entries of (path, mode, type, size); the first rule that holds decides."""
    path = F.coalesce(F.col("path"), F.lit(""))
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    extension = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    some = lambda values: F.arrays_overlap(folders, F.array(*(F.lit(v) for v in values)))
    ends = lambda c, values: c.rlike("(" + "|".join(v.replace(".", r"\.") for v in values) + ")$")
    unsafe = (path == "") | F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\\")) | F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    secret = name.isin(*SECRET_NAMES) | extension.isin(*SECRET_EXTENSIONS) | (F.startswith(name, F.lit(".env")) & ((name == ".env") | ~ends(name, TEMPLATE_SUFFIXES)))
    reason = (
        F.when(F.col("mode") == "160000", "submodule")
        .when(F.col("mode") == "120000", "symlink")
        .when(unsafe, "unsafe_path")
        .when(F.col("type") != "blob", "not_a_file")
        .when(secret, "secret")
        .when(some(VENDORED_DIRECTORIES), "vendored")
        .when(some(GENERATED_DIRECTORIES) | name.isin(*GENERATED_NAMES) | ends(name, GENERATED_SUFFIXES), "generated")
        .when(extension.isin(*BINARY_EXTENSIONS), "binary")
        .when(F.col("size") > max_bytes, "too_large")
    )
    return entries.withColumn("reason", reason)


def repository(spec: Column) -> tuple[Column, Column]:
    """(owner, name) of a repository's address, ssh form or short form; null if it names none or too much."""
    s = F.trim(spec)
    rest = F.coalesce(*(F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in (r"^(?:[^@\s/]+@)(?:www\.)?github\.com:(.+)$", r"^https?://(?:www\.)?github\.com(?::\d+)?/([^?#]+)$", r"^(?i:(?:www\.)?github\.com)/(.+)$", r"^([^/:@?#]+/[^:@?#]+)$")))
    shape = r"^/*([A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38})/([A-Za-z0-9._-]{1,100}?)(?:\.git)?/*$"
    fits = ~s.rlike(r"[\x00\s\\]") & rest.rlike(shape)
    owner, name = (F.regexp_extract(rest, shape, k) for k in (1, 2))
    good = fits & ~name.isin("", ".", "..")
    return F.when(good, owner), F.when(good, name)


def citation(text: Column) -> dict[str, Column]:
    """Parts of ``owner/name@sha/path#L1-L2`` or ``url#chunk@instant``; kind is null if it is neither."""
    s = F.trim(text)
    repo = r"^([A-Za-z0-9._-]+/[A-Za-z0-9._-]+)@([0-9a-f]{40})/([^#]+)#L(\d+)(?:-L(\d+))?$"
    web = r"^(https?://[^\s#]+)#([A-Za-z0-9._-]+)@(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ)$"
    start, end = (F.nullif(F.regexp_extract(s, repo, k), F.lit("")).cast("int") for k in (4, 5))
    path = F.regexp_extract(s, repo, 3)
    safe = ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\\")) & ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".."))
    is_repo = s.rlike(repo) & safe & (start >= 1) & (end.isNull() | (end >= start))
    is_web = s.rlike(web) & F.regexp_extract(s, web, 3).try_cast("timestamp").isNotNull()
    return {
        "kind": F.when(is_repo, "repo").when(is_web, "web"),
        "target": F.when(is_repo, F.regexp_extract(s, repo, 1)).when(is_web, F.regexp_extract(s, web, 1)),
        "part": F.when(is_repo, path).when(is_web, F.regexp_extract(s, web, 2)),
        "start_line": F.when(is_repo, start),
        "end_line": F.when(is_repo, F.coalesce(end, start)),
    }


def address_class(address: str | None) -> str | None:
    """Why an address may not be contacted, or None; forms that embed another address are unwrapped first."""
    try:
        a = ipaddress.ip_address((address or "").strip())
    except ValueError:
        return "reserved"
    if str(a) in METADATA_ADDRESSES:
        return "cloud_metadata"
    if a.version == 6:
        n = int(a)
        inner = a.ipv4_mapped or a.sixtofour or (ipaddress.IPv4Address(n & 0xFFFFFFFF) if n >> 32 == 0x64FF9B << 64 else None)
        if inner is not None:
            return address_class(str(inner)) or "reserved"
        if a.teredo is not None:
            return "reserved"
    rules = (
        ("unspecified", a.is_unspecified),
        ("loopback", a.is_loopback),
        ("link_local", a.is_link_local),
        ("multicast", a.is_multicast),
        ("carrier_grade_nat", a.version == 4 and int(a) >> 22 == 0x64400000 >> 22),
        ("unique_local", a.version == 6 and (int(a) >> 121 == 0xFC >> 1 or a.is_site_local)),
        ("reserved", a.is_reserved),
        ("private", a.is_private),
        ("not_global", not a.is_global),
    )
    return next((name for name, holds in rules if holds), None)


#: Classes of IPv4 networks as (class, network, bits); the first that holds an address decides, the rest is global.
IPV4_NETWORKS = (
    ("unspecified", "0.0.0.0", 32), ("loopback", "127.0.0.0", 8), ("link_local", "169.254.0.0", 16), ("multicast", "224.0.0.0", 4), ("carrier_grade_nat", "100.64.0.0", 10), ("reserved", "240.0.0.0", 4),
    (None, "192.0.0.9", 32), (None, "192.0.0.10", 32), ("private", "0.0.0.0", 8), ("private", "10.0.0.0", 8), ("private", "172.16.0.0", 12), ("private", "192.0.0.0", 24), ("private", "192.0.2.0", 24),
    ("private", "192.168.0.0", 16), ("private", "198.18.0.0", 15), ("private", "198.51.100.0", 24), ("private", "203.0.113.0", 24),
)
_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$"


def ipv4_class(address: Column) -> Column:
    """``address_class`` of a dotted IPv4 address, by integer comparisons on its number, which is found once."""

    def named(number: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for name, network, bits in IPV4_NETWORKS:
            low = int(ipaddress.ip_address(network))
            out = out.when(number.between(low, low + (1 << (32 - bits)) - 1), F.lit(name))
        return out

    number = F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda n, part: n * 256 + part.try_cast("long"))
    metadata = address.isin(*(a for a in METADATA_ADDRESSES if ":" not in a))
    return F.when(metadata, F.lit("cloud_metadata")).otherwise(bound(number, named))


def address_classes(df: DataFrame, address: str = "address") -> DataFrame:
    """Adds reason to a table of addresses: dotted IPv4 by SQL; each other text once in Python, batch by batch."""

    @F.pandas_udf("string")
    def classify(values: pd.Series) -> pd.Series:
        return values.map(address_class)

    plain = F.trim(F.col(address)).rlike(_IPV4)
    others = df.where(~F.coalesce(plain, F.lit(False)) & F.col(address).isNotNull()).select(F.col(address).alias("_other")).distinct()
    judged = others.withColumn("_class", classify("_other"))
    joined = df.join(judged, F.col(address) == F.col("_other"), "left")
    return joined.withColumn("reason", F.when(F.col(address).isNull(), "reserved").when(plain, ipv4_class(F.trim(F.col(address)))).otherwise(F.col("_class"))).drop("_other", "_class")


def screened_answers(answers: DataFrame, name: str = "name", address: str = "address", order: str = "ordinal", most: int = 8) -> DataFrame:
    """(name, reason, position, address): the first ``most`` addresses of each name, in ``order``, if all of its answers may be used.

    One answer that may not refuses the name: a row with the first reason and without an address. All answers count, those beyond
    ``most`` as well.
    """
    judged = address_classes(answers.select(name, address, order), address)
    refused = judged.where("reason is not null").groupBy(name).agg(F.min_by("reason", order).alias("reason"))
    cleared = judged.join(refused.select(name), name, "left_anti")
    placed = cleared.withColumn("position", F.row_number().over(Window.partitionBy(name).orderBy(order))).where(F.col("position") <= most)
    none = F.lit(None)
    return placed.select(name, none.cast("string").alias("reason"), "position", F.col(address).alias("address")).unionByName(refused.select(name, "reason", none.cast("int").alias("position"), none.cast("string").alias("address")))
