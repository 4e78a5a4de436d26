"""Vocabulary of uploaded column names. FIXED VALUES: canonical names by group, with the alias spellings
(letters and digits only, lower case) that are read as them, and the two rules for names with endings."""

VOCABULARY = {
    "core": {
        "dissolved_oxygen": ["do", "dissolvedoxygen", "dissolvedo2", "dissolvedoxygenmgl", "domgl"],
        "bod": ["bod", "biochemicaloxygendemand", "bodmgl", "biochemicaloxygendemandmgl"],
        "ph": ["ph", "phvalue", "ph1", "ph2", "potentialofhydrogenph"],
    },
    "physical": {
        "temperature": ["temp", "temperature", "temperatureoc"],
        "conductivity": ["conductivity", "conductance", "specificconductance", "electricalconductivity",
                         "electricconductivity", "electricconductivityscm", "ec", "ecuscm",
                         "electricconductivitymscm", "electricconductivityuscm"],
        "turbidity": ["turbidity", "turbidityntu"],
        "total_dissolved_solids": ["totaldissolvedsolids", "totaldissolvedsolidsmgl", "tds"],
        "total_solids": ["ts", "totalsolids", "tfs", "totalsolidsmgl"],
        "total_suspended_solids": ["tss", "totalsuspendedsolids", "totalsuspendedsolidsmgl"],
        "flow": ["flow"],
        "depth": ["depth", "approxdepth"],
        "weather": ["weather"],
        "colour": ["colour", "color"],
        "odour": ["odour", "odor"],
        "floating_matter": ["floatingmatter"],
        "visibility_effluent_discharge": ["visibilityeffluentdischarge"],
    },
    "biological": {
        "fecal_coliform": ["fecalcoliform", "faecalcoliform", "fc", "fecalcoliformmpn100ml"],
        "total_coliform": ["totalcoliform", "tc", "totalcoliformmpn100ml"],
        "fecal_streptococci": ["fecalstreptococci", "faecalstreptococci"],
        "e_coli": ["ecoli"],
    },
    "chemical": {
        "nitrate": ["nitrate", "nitraten", "nitratemgl", "no3", "nitritennitraten", "nitritennitratenmgnl", "nitratenmgnl"],
        "nitrite": ["nitrite", "nitriten"],
        "ammonia": ["ammonia", "amonian", "ammonian", "ammonicalnitrogen", "amonianmgnl"],
        "phosphate": ["phosphate", "totalphosphorus", "totalphosphorusmgpl", "orthophosphate"],
        "carbonate": ["carbonate", "carbonatemgl"],
        "bicarbonate": ["bicarbonate", "bicarbonatemgl"],
        "alkalinity": ["alkalinity", "totalalkalinity", "totalalkalinitymglascaco3"],
        "chloride": ["chloride", "chlorides", "chloridemgl"],
        "sulphate": ["sulphate", "sulfate", "sulphatemgl", "sulfatemgl"],
        "fluoride": ["fluoride", "fluoridemgl"],
        "calcium": ["calcium", "calciummgl"],
        "magnesium": ["magnesium", "magnesiummgl"],
        "sodium": ["sodium", "sodiummgl"],
        "potassium": ["potassium", "potassiummgl"],
        "hardness": ["hardness", "totalhardness", "totalhardnessmgcaco3l", "hardnesscaco3", "hardnessascaco3",
                     "hardnesscalciummgcaco3l", "hardnessmagnesiummglascaco3"],
        "cod": ["cod", "chemicaloxygendemand", "chemicaloxygendemandmgl"],
        "sodium_adsorption_ratio": ["sar", "sodiumadsorptionratio"],
        "arsenic": ["arsenic", "arsenicmgl"],
        "cadmium": ["cadmium", "cadmiummgl"],
        "chromium": ["chromium", "chromiummgl"],
        "copper": ["copper", "coppermgl"],
        "iron": ["iron", "ironmgl"],
        "lead": ["lead", "leadmgl"],
        "manganese": ["manganese", "manganesemgl"],
        "mercury": ["mercury", "mercurymgl"],
        "nickel": ["nickel", "nickelmgl"],
        "zinc": ["zinc", "zincmgl"],
        "boron": ["boron", "boronmgl"],
    },
    "metadata": {
        "station_name": ["stationname", "stationcode", "sitecode", "monitoringlocation", "location", "station", "stnname"],
        "river_name": ["rivername", "waterbody", "nameofwaterbody", "basin", "tributary", "subtributary",
                       "subsubtributary", "localriver", "river"],
        "state": ["statename", "state", "statelgdcode"],
        "district": ["districtname", "district", "districtlgdcode", "tehsil", "block", "village"],
        "agency": ["agencyname", "agency", "monitoringagency", "monagency"],
        "sampling_date": ["date", "samplingdate", "dataacquisitiontime", "samplingtime", "frequency"],
        "year": ["year"],
        "month": ["month"],
        "season": ["season"],
        "latitude": ["lat", "latitude"],
        "longitude": ["lon", "longitude"],
        "human_activities": ["humanactivities", "majorpollutingsources", "useofwaterindownstream", "usebasedclass"],
        "sample_id": ["sampleid", "slno", "id"],
    },
}
#: Names that begin with a metal and end with this unit are that metal.
METALS = ["arsenic", "cadmium", "chromium", "copper", "iron", "lead", "manganese", "mercury", "nickel", "zinc", "boron"]
METAL_UNIT = "mgl"
#: Names that begin like this are that quantity.
BEGINNINGS = {"temperature": "temperature"}
#: Names that are never mapped.
IGNORED = ["class"]
#: Numeric quantities whose values are cleaned and flagged.
NUMERIC = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity", "turbidity", "total_dissolved_solids",
           "total_solids", "total_suspended_solids", "flow", "depth", "fecal_coliform", "total_coliform",
           "fecal_streptococci", "e_coli", "nitrate", "nitrite", "ammonia", "phosphate", "carbonate", "bicarbonate",
           "alkalinity", "chloride", "sulphate", "fluoride", "calcium", "magnesium", "sodium", "potassium", "hardness",
           "cod", "sodium_adsorption_ratio", "arsenic", "cadmium", "chromium", "copper", "iron", "lead", "manganese",
           "mercury", "nickel", "zinc", "boron"]
