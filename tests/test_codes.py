"""The fixed lists against counts and members written down apart from them, as both engines read the same lists."""

import pytest

from stayline.functions import codes

COUNTS = {
    "ARREST_CODES": 22, "BETA_BLOCKERS": 6, "BLOOD_ITEMS": 4, "BUMETANIDE": 7, "CALCIUM_ANTAGONISTS": 5,
    "CARDIAC_SERVICES": 2, "CARDIAC_UNITS": 2, "CHRONIC_DIALYSIS_CODES": 2, "COLLOID_ITEMS": 3, "CRYSTALLOID_ITEMS": 4,
    "DAILY_OUTPUT_ITEMS": 63, "DIALYSIS_ITEMS": 4, "ETHACRYNATE": 2, "HOURLY_OUTPUT_ITEMS": 51, "INTAKE_ITEMS": 124,
    "LOOP_DIURETICS": 20, "MONITOR_MEASURES": 16, "PRESSOR_ITEMS": 8, "RATE_CONTROL_NAMES": 9, "URINE_ITEMS": 12,
    "VENTILATED": 3,
}

MEMBERS = {
    "CRYSTALLOID_ITEMS": {225828, 225827, 225158, 225825},
    "COLLOID_ITEMS": {220864, 225795, 225174},
    "CHRONIC_DIALYSIS_CODES": {"Z992", "V4511"},
    "PRESSOR_ITEMS": {221906, 221749, 222315, 221289, 221662, 221653, 221986, 229764},
    "CARDIAC_UNITS": {"Coronary Care Unit (CCU)", "Cardiac Vascular Intensive Care Unit (CVICU)"},
    "VENTILATED": {"Tracheostomy", "InvasiveVent", "NonInvasiveVent"},
    "CALCIUM_ANTAGONISTS": {"Diltia", "Diltiaz", "Diltiazem", "Verapamil", "Verapamil HCl"},
}


@pytest.mark.parametrize("name", COUNTS)
def test_lists_are_complete_and_without_repeats(name):
    listed = list(getattr(codes, name))
    assert len(listed) == len(set(listed)) == COUNTS[name]


@pytest.mark.parametrize("name", MEMBERS)
def test_short_lists_hold_what_they_should(name):
    assert set(getattr(codes, name)) == MEMBERS[name]
