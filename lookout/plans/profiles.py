"""Ready-made rule profiles."""

from __future__ import annotations

from lookout.operators.rules import Profile

# The keyword lists of the robotics profile, in list order.
ROBOTICS = Profile(
    profile_id="robotics",
    min_score=3,
    require_location_match=True,
    include_keywords=(
        "robotics engineer", "robotics software", "robot", "ros", "ros 2",
        "motion planning", "manipulation", "perception engineer", "autonomy", "autonomous",
        "mechatronics", "controls engineer", "control systems", "actuation",
        "mechanical engineer", "mechanical design", "design engineer",
        "product development engineer", "r&d engineer", "research and development",
        "fea", "dfm",
        "embedded systems", "embedded software", "firmware", "sensor integration",
        "sensor systems", "systems engineer", "integration engineer", "hardware engineer",
        "test engineer", "hardware test", "reliability engineer", "automation engineer",
        "manufacturing engineer", "applications engineer", "field engineer", "field robotics",
        "medical device", "medical robotics", "surgical robotics", "wearable",
        "rehabilitation", "imaging hardware",
    ),
    exclude_keywords=(
        "senior", "sr", "staff", "principal", "lead", "director", "manager", "vp",
        "head of", "chief", "fellow",
        "sales", "account executive", "recruiter", "intern", "internship", "technician",
        "marketing",
    ),
    hard_exclude_anywhere=(
        "security clearance", "active clearance", "ts/sci", "secret clearance", "top secret",
        "must be a u.s. citizen", "u.s. citizenship is required",
        "us citizenship is required", "u.s. citizenship required", "itar", "export control",
    ),
    level_signals_positive=(
        "new grad", "new graduate", "university grad", "university graduate",
        "early career", "early-career", "entry level", "entry-level", "associate engineer",
        "0-2 years", "0 to 2 years", "1-2 years", "2026", "2027", "masters", "master's",
        "recent graduate", "rotational", "graduate program",
    ),
    locations=(
        "united states", "usa", "u.s.", " us ", " us,", "remote",
        "new york", "ny,", " ny ", "new jersey", "nj,", "california", "ca,",
        "san francisco", "bay area", "sunnyvale", "santa clara", "san jose",
        "mountain view", "palo alto", "boston", "cambridge", "ma,", "waltham",
        "seattle", "redmond", "wa,", "austin", "tx,", "pittsburgh", "pa,",
        "minneapolis", "minnesota", "mn,", "michigan", "mi,", "indiana", "in,",
        "colorado", "co,", "oregon", "or,",
    ),
)

# Our own profiles for invented prose, used by the registered queries.
PROSE = Profile(
    profile_id="prose",
    min_score=3,
    require_location_match=True,
    include_keywords=("tion", "thin", "reting", "eau", "lich", "ción", "ing the", "eati"),
    exclude_keywords=("idiot", "moron", "pathetic", "worthless", "der", "ros", "was"),
    hard_exclude_anywhere=("token =", "password", "all rights reserved"),
    level_signals_positive=("license", "for the", "und", "para", "menta"),
    locations=("en", "fr", "es"),
)
POLITE = Profile(
    profile_id="polite",
    min_score=1,
    require_location_match=False,
    include_keywords=("the", "die", "les"),
    exclude_keywords=("idiot", "moron", "pathetic", "worthless"),
    level_signals_positive=("with",),
)
