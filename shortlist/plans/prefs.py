"""The preference sets that queries use, in the vocabulary of the parts."""

from shortlist.operators.rules import Boost, Cap, Preferences

PREFS = Preferences(
    target_roles=["widget", "gizmo"],
    adjacent_roles=["ring"],
    reject_roles=["rod"],
    dealbreakers=["5-LOW"],
    positive_signals=["1-URGENT", "2-HIGH", "role", "Brand#1", "STANDARD"],
    negative_signals=["plate"],
    hard_caps=[Cap(["anvil"], 3, "anvils"), Cap(["bolt", "gear"], 6, None)],
    location_boosts=[Boost(["Remote"], 1, 6, 9, "remote"), Boost(["FRANCE", "GERMANY", "NATION_7"], 2, 7, 10, None)],
)

#: Three profiles for scoring against many: the last has no signals, but low caps.
PROFILES = {
    "a": Preferences(target_roles=["widget"], adjacent_roles=["ring"], reject_roles=["rod"], positive_signals=["role", "1-urgent", "2-high", "remote"]),
    "b": Preferences(target_roles=["widget"], adjacent_roles=["ring"], dealbreakers=["5-low"], positive_signals=["role", "1-urgent", "2-high", "remote"], negative_signals=["plate"]),
    "c": Preferences(target_roles=["widget", "gizmo"], hard_caps=[Cap(["anvil", "bolt"], 3, "heavy"), Cap(["gear"], 1, None), Cap(["ring"], 6, "rings")]),
}
