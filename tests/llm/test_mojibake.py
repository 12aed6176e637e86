from __future__ import annotations

import pytest

from strandline.llm.mojibake import repair_documents

SOUND = [
    "La caméra a été inversée à gauche, déjà vérifiée près de l’arrêt.",
    "Größere Lücken gehören nicht zur Übungsfahrt, für Straßen überprüft.",
    "¿Por qué la señal quedó fija? Nadie lo sabe todavía, según el último vídeo.",
    "NÃO HÁ ÂNGULO MORTO À DIREITA; SÃO 2 CÂMERAS. Ã, õ e ç somem na estação.",
    "Samochód skręcił w lewo, choć ścieżka kończy się później; położenie wątpliwe.",
    "Велосипедист держался правой полосы, затем пересёк кольцо и скрылся.",
    "カメラが上下逆に取り付けられていたため、流れの向きが信用できない。",
    "We’d rather keep “doubtful” pairs — fees are £30, €16 or ¥18; ±0.6 °C.",
    "The plate reads ÐÞ-8716-ÆÅ near the café.",
    "Plain text without anything beyond ASCII.",
]


def _damage():
    out = []
    for read in ("cp1252", "latin-1", "cp1250", "cp437", "cp850", "mac_roman"):
        for k in (0, 1, 2):
            raw = SOUND[k].encode("utf-8")
            out.append((SOUND[k], "".join(bytes([b]).decode(read, "replace") if read != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)))
    out.append((SOUND[5], SOUND[5].encode("utf-8").decode("cp1251", "replace")))
    out.append((SOUND[5], SOUND[5].encode("cp1251").decode("cp1252")))
    out.append((SOUND[5], SOUND[5].encode("koi8_r").decode("cp1251")))
    out.append((SOUND[4], SOUND[4].encode("cp1250").decode("cp1252", "replace")))
    out.append((SOUND[6], "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in SOUND[6].encode("cp932"))))
    out.append((SOUND[0], SOUND[0].encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")))  # twice
    out.append((SOUND[1], SOUND[1].encode("mac_roman").decode("cp1252", "replace")))
    out.append((SOUND[2] + " " + SOUND[8], SOUND[2] + " " + SOUND[8].encode("utf-8").decode("latin-1")))  # in part
    return out


@pytest.fixture(scope="module")
def repaired(spark):
    damage = _damage()
    rows = [(k, SOUND[k % len(SOUND)]) for k in range(2000)] + [(10_000 + k, bad) for k, (_, bad) in enumerate(damage)]
    rows += [(20_000, None), (20_001, ""), (20_002, "  \n"), (20_003, "lost �"), (20_004, "Größe " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' as garbled")
    return damage, {r["doc_id"]: r for r in repair_documents(df, "text").collect()}


def test_sound_texts_stay(repaired):
    _, out = repaired
    for k in range(2000):
        assert not out[k]["garbled_1"], out[k]["text"]
        assert out[k]["restored"] == out[k]["text"] and out[k]["garbled"] == "mine"


def test_damage_is_found(repaired):
    damage, out = repaired
    for k, (sound, bad) in enumerate(damage):
        assert out[10_000 + k]["garbled_1"], bad


def test_most_damage_is_undone(repaired):
    damage, out = repaired
    right = [out[10_000 + k]["restored"] == sound for k, (sound, bad) in enumerate(damage) if "�" not in bad]
    assert sum(right) >= 0.9 * len(right), [(d, out[10_000 + k]["restored"]) for k, d in enumerate(damage) if "�" not in d[1] and out[10_000 + k]["restored"] != d[0]]


def test_odd_texts(repaired):
    _, out = repaired
    assert not out[20_000]["garbled_1"] and out[20_000]["restored"] is None
    assert not out[20_001]["garbled_1"] and not out[20_002]["garbled_1"] and not out[20_004]["garbled_1"]
    assert out[20_003]["garbled_1"]


def test_no_documents(spark):
    assert repair_documents(spark.createDataFrame([], "text string"), "text").collect() == []
