"""Builds small catalogues on disk, with digests made by hashlib and json."""

import hashlib
import json
import os

HOSTS = {"label": "http://labels.example.org/labels/v1.1", "trace": "http://traces.example.net/point"}


def names_of(date):
    """The five payload names of a day and their kinds."""
    return {
        "notice_csv": f"{date}_notice.csv",
        "notice_xml": f"{date}_notice.xml",
        "anomalous_csv": f"{date}_anomalous_suspicious.csv",
        "anomalous_xml": f"{date}_anomalous_suspicious.xml",
        "trace": f"{date}1400.pcap.gz",
    }


def url_of(name):
    date = name[:8]
    if name.endswith(".gz"):
        return f"{HOSTS['trace']}/{date[:4]}/{name}"
    return f"{HOSTS['label']}/{date[:4]}/{date[4:6]}/{date[6:]}/{name}"


def record(name, size=4506, **changes):
    """The values of one record; ``changes`` replace single values before rendering."""
    values = {
        "name": name,
        "frozen": "true",
        "url": url_of(name),
        "dep_size": size,
        "out_size": size,
        "dep_hash": "md5",
        "out_hash": "md5",
        "out_md5": hashlib.md5(f"{name}{size}".encode()).hexdigest(),
        "etag": f"{size:x}-4c0ffee123456" if name.endswith(".gz") else str(270000000 + size),
    }
    values.update(changes)
    return values


def stage_md5(v):
    body = {
        "deps": [{"checksum": f'"{v["etag"]}"', "hash": v["dep_hash"], "path": v["url"]}],
        "outs": [{"hash": v["out_hash"], "md5": v["out_md5"], "path": v["name"]}],
    }
    return hashlib.md5(json.dumps(body, sort_keys=True).encode()).hexdigest()


def text_of(v, layout="plain"):
    """The record as text. Layouts: plain, folded (URL on its own line), reordered (outs keys)."""
    url = f"  path: \n    {v['url']}" if layout == "folded" else f"  path: {v['url']}"
    outs = {
        "hash": v["out_hash"], "path": v["name"], "md5": v["out_md5"], "size": v["out_size"],
    }
    order = ["md5", "size", "hash", "path"] if layout == "reordered" else list(outs)
    lines = [
        f"md5: {v.get('stage_md5') or stage_md5(v)}",
        f"frozen: {v['frozen']}",
        "deps:",
        f"- checksum: '\"{v['etag']}\"'",
        f"  size: {v['dep_size']}",
        f"  hash: {v['dep_hash']}",
        url,
        *v.get("more_deps", []),
        "outs:",
        *[f"{'- ' if i == 0 else '  '}{k}: {outs[k]}" for i, k in enumerate(order)],
    ]
    return "\n".join(lines) + "\n"


def layout_of(v):
    return "folded" if len(v["url"]) + 8 > 80 else "plain"


def write_record(root, date, v, layout=None, file_name=None):
    folder = os.path.join(root, f"year={date[:4]}", f"month={date[4:6]}", f"day={date[6:8]}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{file_name or v['name']}.dvc")
    with open(path, "w") as out:
        out.write(text_of(v, layout or layout_of(v)))
    return path


def write_tree(root):
    """Eight days with gaps; not every day has every kind. Returns {name: values}."""
    days = {
        "20101230": list(names_of("")), "20101231": ["notice_csv", "notice_xml", "trace"],
        "20110101": list(names_of("")), "20110105": ["anomalous_csv", "trace"],
        "20110106": ["notice_csv", "notice_xml"], "20110107": list(names_of("")),
        "20120301": ["trace"], "20120302": list(names_of("")),
    }
    written = {}
    for i, (date, kinds) in enumerate(days.items()):
        for kind in kinds:
            name = names_of(date)[kind]
            v = record(name, size=3_000_000_000 + i if kind == "trace" else 100 * (i + 1))
            layout = "reordered" if date == "20120302" and kind == "trace" else None
            write_record(root, date, v, layout)
            written[name] = v
    return written
