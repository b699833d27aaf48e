"""A catalogue from a dump, and the way back from its document."""

import json

import pytest

from orrery.sources import catalog, templates

DUMP = [
    {"templateId": "V0016_POKEMON_PIDGEY", "data": {"pokemonSettings": {"pokemonId": "PIDGEY", "stats": {"baseAttack": 85, "baseDefense": 73, "baseStamina": 120}, "evolutionBranch": [{"evolution": "PIDGEOTTO"}, "x", {"no": 1}]}}},
    {"templateId": "V0016_POKEMON_PIDGEY_NORMAL", "data": {"templateId": "V0016_POKEMON_PIDGEY_NORMAL", "pokemonSettings": {"pokemonId": "PIDGEY", "form": "PIDGEY_NORMAL", "stats": {"baseAttack": "86", "baseDefense": 73, "baseStamina": 120.0}}}},
    {"templateId": "other", "pokemonSettings": {"pokemon_id": "MR_MIME", "pokedexId": "122", "form": "MR_MIME_GALARIAN", "stats": {"baseAttack": True, "baseDefense": 1, "baseStamina": 1}, "evolutionBranch": [{"evolution": "MR_RIME", "form": "MR_RIME_NORMAL"}, {"evolution": "MR_RIME", "form": "MR_RIME_NORMAL"}]}},
    {"templateId": "nodex", "pokemonSettings": {"pokemonId": "GHOST"}},
    {"templateId": "V0221_MOVE_TACKLE_FAST", "moveSettings": {"movementId": "TACKLE_FAST", "pokemonType": "POKEMON_TYPE_NORMAL"}},
    {"templateId": "COMBAT_V0221", "combatMove": {"uniqueId": "VINE_WHIP", "type": ""}},
    {"templateId": "V9", "moveSettings": {"movementId": "VINE_WHIP", "pokemonType": "POKEMON_TYPE_GRASS"}},
    {"templateId": "PLAYER", "playerLevel": {"cpMultiplier": [0.1, True, "x", 0.2, 0.3]}},
    {"templateId": "LATER", "playerLevel": {"cpMultiplier": [0.9]}},
]


@pytest.mark.parametrize("root", ["list", "object"])
def test_dump_to_document_and_back(spark, tmp_path, root):
    (tmp_path / "dump.json").write_text(json.dumps(DUMP if root == "list" else {"itemTemplates": DUMP}))
    counts = templates.sync(spark, f"{tmp_path}/dump.json", f"{tmp_path}/out", generated_at="now")
    assert counts == {"species": 2, "moves": 2, "evolutions": 2, "base_stats": 1, "cp_multipliers": 5}
    got = {k: [r.asDict() for r in v.collect()] for k, v in catalog.read_catalog(spark, f"{tmp_path}/out").items()}
    assert [(s["species_key"], s["pokedex_id"], s["species_name"]) for s in got["species"]] == [("pidgey", 16, "Pidgey"), ("mr-mime", 122, "Mr. Mime")]
    assert got["species"][0]["forms"] == ["Normal"] and got["species"][0]["upstream_ids"] == ["PIDGEY", "V0016_POKEMON_PIDGEY", "V0016_POKEMON_PIDGEY_NORMAL"]
    assert [(m["move_key"], m["move_name"], m["move_type"], m["category"]) for m in got["moves"]] == [("tackle-fast", "Tackle", "Normal", "fast"), ("vine-whip", "Vine Whip", "Grass", "combat")]
    assert [(e["species_key"], e["form"], e["evolves_to_key"], e["evolves_to_form"]) for e in got["evolutions"]] == [("mr-mime", "Galarian", "mr-rime", "Normal"), ("pidgey", None, "pidgeotto", None)]
    assert [(b["species_key"], b["form"], b["base_attack"]) for b in got["base_stats"]] == [("pidgey", "Normal", 86)]
    assert [(c["level"], round(c["cpm"], 9)) for c in got["cp_multipliers"]] == [(1.0, 0.1), (1.5, 0.158113883), (2.0, 0.2), (2.5, 0.254950976), (3.0, 0.3)]


def test_dumps_that_give_nothing(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"templateId": "x"}]')
    with pytest.raises(ValueError, match="no entry"):
        templates.sync(spark, f"{tmp_path}/bad.json", f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()
    (tmp_path / "none.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="no list of templates"):
        templates.sync(spark, f"{tmp_path}/none.json", f"{tmp_path}/out")
