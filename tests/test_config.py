import copy

import pytest

from headwater.config import load_config, parse_config

BASE = {
    "dataset": {"region": "na"},
    "projects": [
        {"id": "UPPER", "name": "Upper", "project_code": "UP", "mw": 5, "outlet": {"hybas_id": 1, "lon": 0.5, "lat": 1.5, "source": "map"}},
        {"id": "LOWER", "name": "Lower", "outlet": {"hybas_id": 7120225080, "lon": 0.5, "lat": 0}},
    ],
}


def changed(**at):
    document = copy.deepcopy(BASE)
    for path, value in at.items():
        *parents, last = path.split("__")
        here = document
        for p in parents:
            here = here[int(p)] if p.isdigit() else here[p]
        if value is None:
            del here[last]
        else:
            here[last] = value
    return document


def test_defaults_and_order(spark):
    c = parse_config(BASE)
    assert (c.dataset.level, c.dataset.version, c.dataset.include_virtual_connections, c.dataset.stem) == (12, "1c", False, "hybas_na_lev12_v1c")
    assert c.projects[0].metadata == {"project_code": "UP", "mw": 5} and c.projects[0].source == "map"
    rows = c.frame(spark).orderBy("ord").collect()
    assert [(r["id"], r["hybas_id"], r["mw"], r["project_code"]) for r in rows] == [("UPPER", 1, 5.0, "UP"), ("LOWER", 7120225080, None, None)]


@pytest.mark.parametrize(
    ("change", "text"),
    [
        ({"projects__1__outlet__hybas_id": 1}, "same.*unit"), ({"dataset__include_virtual_connections": "false"}, "true or false"), ({"projects__0__rivr": "x"}, r"projects\[1\]: no setting is called rivr"),
        ({"projects__1__project_code": "up"}, "same project code"), ({"projects__1__id": "upper"}, "same id"), ({"projects__0__id": "a b"}, "id: wanted"), ({"projects__0__id": "A\n"}, "id: wanted"),
        ({"dataset__level": True}, "level"), ({"dataset__level": 13}, "level"), ({"dataset__version": 1}, "version"), ({"dataset__region": "xx"}, "region"), ({"dataset__region": ["na"]}, "region"), ({"projects": []}, "list"), ({"projects": {}}, "list"),
        ({"projects__0__outlet__lon": 181}, "lon"), ({"projects__0__outlet__lat": float("nan")}, "lat"), ({"projects__0__outlet__lat": True}, "lat"), ({"projects__0__mw": -1}, "mw"), ({"projects__0__river": " "}, "river"),
        ({"projects__0__outlet__source": ""}, "source"), ({"projects__0__name": None}, "name: left out"), ({"projects__0__outlet__hybas_id": 0}, "hybas_id"), ({"extra": 1}, "settings: no setting is called extra"), ({"projects__0__outlet": 5}, "outlet: wanted a table"),
        ({"projects__0__project_code": "a b"}, "project_code"), ({"dataset": None}, "dataset: left out"),
    ],
)
def test_rejections(change, text):
    with pytest.raises(ValueError, match=text):
        parse_config(changed(**change))


def test_invalid_yaml(tmp_path):
    (tmp_path / "c.yaml").write_text("dataset: [")
    with pytest.raises(ValueError, match="YAML"):
        load_config(tmp_path / "c.yaml")


def test_all_problems_are_told_at_once():
    with pytest.raises(ValueError) as told:
        parse_config(changed(dataset__region="xx", projects__0__mw="5", projects__1__outlet__lat=91))
    assert all(text in str(told.value) for text in ("dataset.region", "projects[1].mw", "projects[2].outlet.lat"))
