"""Download and verify a regional dataset: staged, checked, hashed and published file by file, the manifest last."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import urllib.request
import zipfile
from pathlib import Path
from zlib import error as zlib_error

from headwater.config import Dataset, check_dataset

MANIFEST = "manifest.json"
SUFFIXES = (".shp", ".shx", ".dbf", ".prj")
BLOCK, TIMEOUT = 1 << 20, 60


def sha256_file(path: Path) -> str:
    with Path(path).open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def files_of(dataset: Dataset) -> list[str]:
    """What a dataset's folder holds besides its manifest: the archive and the files of the layer."""
    return [dataset.stem + s for s in (".zip", *SUFFIXES)]


def is_cached(folder: Path, dataset: Dataset) -> bool:
    """Do the manifest and every file's hash agree? Links, and anything unreadable or odd, count as no."""
    try:
        if (folder / MANIFEST).is_symlink():
            return False
        told = json.loads((folder / MANIFEST).read_text(encoding="utf-8"))
        held = {n: sha256_file(folder / n) for n in files_of(dataset) if not (folder / n).is_symlink()}
        return told["source_url"] == dataset.url and told["sha256"] == held and len(held) == 1 + len(SUFFIXES)
    except (OSError, ValueError, KeyError, TypeError):
        return False


def fetch(url: str, to: Path) -> None:
    request = urllib.request.Request(url, headers={"User-Agent": "headwater"})
    with urllib.request.urlopen(request, timeout=TIMEOUT) as stream, to.open("wb") as out:
        shutil.copyfileobj(stream, out, BLOCK)


def _members(archive: zipfile.ZipFile, names: list[str]) -> list[zipfile.ZipInfo]:
    if (bad := archive.testzip()) is not None:
        raise ValueError(f"archive member {bad} is damaged")
    found = []
    for name in names:
        same = [m for m in archive.infolist() if m.filename == name]
        if len(same) != 1 or same[0].is_dir() or (same[0].external_attr >> 16) & 0o170000 not in (0, 0o100000):
            raise ValueError(f"archive must hold {name} once, as a plain file")
        found.append(same[0])
    return found


def download_dataset(region: str, level: int, version: str, cache_dir: str | Path, get=fetch) -> Path:
    """Path of the verified .shp file in the dataset's own folder of ``cache_dir``; fetched only if what is there fails verification.

    OSError if the archive can't be fetched, ValueError if it is not what it should be; then nothing is published.
    """
    check_dataset(region, level, version)
    dataset = Dataset(region, level, version)
    folder = Path(cache_dir) / dataset.stem
    if folder.is_symlink():
        raise ValueError("the dataset's cache folder must not be a symbolic link")
    shp, zipped = folder / f"{dataset.stem}.shp", f"{dataset.stem}.zip"
    if is_cached(folder, dataset):
        return shp
    folder.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=folder.parent, prefix=".staged-") as stage:
        stage = Path(stage)
        try:
            get(dataset.url, stage / zipped)
        except OSError as error:
            raise OSError(f"the download of {dataset.url} failed: {error}") from error
        try:
            with zipfile.ZipFile(stage / zipped) as archive:
                for member in _members(archive, [dataset.stem + s for s in SUFFIXES]):
                    with archive.open(member) as source, (stage / member.filename).open("wb") as out:
                        shutil.copyfileobj(source, out, BLOCK)
        except (zipfile.BadZipFile, zlib_error, EOFError, NotImplementedError, RuntimeError) as error:
            raise ValueError(f"archive of {dataset.stem} is damaged: {error}") from error
        names = files_of(dataset)
        (stage / MANIFEST).write_text(json.dumps({"source_url": dataset.url, "sha256": {n: sha256_file(stage / n) for n in names}}, indent=2) + "\n", encoding="utf-8")
        folder.mkdir(exist_ok=True)
        for n in (*names, MANIFEST):
            os.replace(stage / n, folder / n)
    return shp
