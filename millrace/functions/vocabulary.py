"""Names of features, the rule that gives their default aliases, and the phrases that name them."""

from __future__ import annotations

#: Canonical feature names.
FEATURES = (
    "10肽", "Alarm_NMR Rule", "Acute Toxicity Rule", "AMES Toxicity", "Aquatic Toxicity Rule", "A549 Cytotoxicity", "BCF",
    "BCRP inhibitor", "BMS Rule", "BBB", "Boiling point", "Caco-2 Permeability", "Carcinogenicity", "Chelating Rule",
    "CL_plasma", "CYP1A2 inhibitor", "CYP1A2 substrate", "CYP2B6 inhibitor", "CYP2B6 substrate", "CYP2C19 inhibitor",
    "CYP2C19 substrate", "CYP2C8 inhibitor", "CYP2C9 inhibitor", "CYP2C9 substrate", "CYP2D6 inhibitor",
    "CYP2D6 substrate", "CYP3A4 inhibitor", "CYP3A4 substrate", "DILI", "Density", "Eye Corrosion", "Eye Irritation",
    "FDAMDD", "FLuc inhibitors", "Flexibility", "Fsp3", "F20%", "F30%", "F50%", "Fu", "GASA", "GSK Rule",
    "GoldenTriangle", "Genotoxic Carcinogenicity Mutagenicity Rule", "Genotoxicity", "Green fluorescence", "HBD (nHD)",
    "HBA (nHA)", "Hek293 Cytotoxicity", "HIA", "HLM Stability", "Human Hepatotoxicity", "IG C50", "IGC50", "LC50DM",
    "LC50FM", "Lipinski Rule", "logD7.4", "logP", "logS", "MCE-18", "MDCK Permeability", "Melting point",
    "Molecular Weight (MW)", "NPscore", "NonBiodegradable", "NonGenotoxic Carcinogenicity Rule", "nHet", "nHD", "nHA",
    "nRing", "nRig", "nRot", "NR-AR", "NR-AR-LBD", "NR-AhR", "NR-Aromatase", "NR-ER", "NR-ER-LBD", "NR-PPAR-gamma",
    "PAINS", "PAMPA", "Pfizer Rule", "PPB", "Promiscuous compounds", "QED", "Rat Oral Acute Toxicity", "Respiratory",
    "RPMI-8226 Immunitoxicity", "Reactive compounds", "SAscore", "Skin Sensitization", "Skin Sensitization Rule",
    "Stereo Centers", "SR-ARE", "SR-ATAD5", "SR-HSE", "SR-MMP", "SR-p53", "Topological Polar Surface Area (TPSA)", "T1/2",
    "Toxicity: Eye Corrosion", "Toxicity: Eye Irritation", "Toxicity: Human Hepatotoxicity",
    "Toxicity: Drug-induced Nephrotoxicity", "Toxicity: Drug-induced Neurotoxicity", "Toxicity: Ototoxicity",
    "Toxicity: Hematotoxicity", "Toxicity: Genotoxicity", "Toxicity: Carcinogenicity", "Toxicity: Skin Sensitization",
    "Toxicity: DILI", "Toxicity: AMES Toxicity", "Toxicity: Rats Oral Acute Toxicity", "Toxicity: FDAMDD",
    "Toxicity: RPMI-8226 Immunitoxicity", "Toxicity: A549 Cytotoxicity", "Toxicity: Hek293 Cytotoxicity", "Toxicity: BCF",
    "Toxicity: IGC50", "Toxicity: LC50DM", "Toxicity: LC50FM", "hERG Blockers", "Pgp inhibitor", "Pgp substrate",
)

#: Names that stand for another one, looked up after the aliases.
MERGES = {
    "nRot": "Flexibility",
    "Roam (nRot)": "Flexibility",
    "nHD": "HBD (nHD)",
    "nHA": "HBA (nHA)",
    "Drug induced Neurotoxicity": "Toxicity: Drug-induced Neurotoxicity",
    "Drug-induced Neurotoxicity": "Toxicity: Drug-induced Neurotoxicity",
    "Drug induced Nephrotoxicity": "Toxicity: Drug-induced Nephrotoxicity",
    "Drug-induced Nephrotoxicity": "Toxicity: Drug-induced Nephrotoxicity",
    "Drug induced Ototoxicity": "Toxicity: Ototoxicity",
    "Drug-induced Ototoxicity": "Toxicity: Ototoxicity",
    "Drug induced Hematotoxicity": "Toxicity: Hematotoxicity",
    "Drug-induced Hematotoxicity": "Toxicity: Hematotoxicity",
}

#: Phrases of a reasoning, the feature and direction each names; a phrase listed again changes what it
#: names and keeps its place.
PHRASES = (
    ("low caco-2 permeability", "Caco-2 Permeability", "down"), ("poor permeability", "Caco-2 Permeability", "down"),
    ("permeability issues", "Caco-2 Permeability", "down"), ("permeability", "Caco-2 Permeability", "down"),
    ("low solubility", "logS", "down"), ("poor solubility", "logS", "down"), ("solubility issues", "logS", "down"),
    ("solubility", "logS", "down"), ("high clearance", "CL_plasma", "up"), ("rapid clearance", "CL_plasma", "up"),
    ("clearance issues", "CL_plasma", "up"), ("clearance", "CL_plasma", "up"),
    ("cyp1a2 inhibition", "CYP1A2 inhibitor", "up"), ("cyp1a2 inhibitor", "CYP1A2 inhibitor", "up"),
    ("cyp3a4 inhibition", "CYP3A4 inhibitor", "up"), ("cyp3a4 inhibitor", "CYP3A4 inhibitor", "up"),
    ("cyp2c19 inhibition", "CYP2C19 inhibitor", "up"), ("cyp2c19 inhibitor", "CYP2C19 inhibitor", "up"),
    ("cyp2c9 inhibition", "CYP2C9 inhibitor", "up"), ("cyp2c9 inhibitor", "CYP2C9 inhibitor", "up"),
    ("cyp450", "CYP3A4 inhibitor", "up"), ("cyp", "CYP3A4 inhibitor", "up"), ("herg blockage", "hERG Blockers", "up"),
    ("herg inhibition", "hERG Blockers", "up"), ("cardiac issues", "hERG Blockers", "up"),
    ("genotoxicity", "Genotoxicity", "up"), ("mutagenicity", "Genotoxicity", "up"), ("dna damage", "Genotoxicity", "up"),
    ("hepatotoxicity", "DILI", "up"), ("liver toxicity", "DILI", "up"), ("liver injury", "DILI", "up"),
    ("dili", "DILI", "up"), ("neurotoxicity", "Toxicity: Drug-induced Neurotoxicity", "up"),
    ("cns toxicity", "Toxicity: Drug-induced Neurotoxicity", "up"),
    ("brain toxicity", "Toxicity: Drug-induced Neurotoxicity", "up"), ("ames toxicity", "AMES Toxicity", "up"),
    ("ames test", "AMES Toxicity", "up"), ("mutagenic", "AMES Toxicity", "up"),
    ("carcinogenicity", "Carcinogenicity", "up"), ("cancer risk", "Carcinogenicity", "up"),
    ("skin sensitization", "Skin Sensitization", "up"), ("allergic reaction", "Skin Sensitization", "up"),
    ("eye irritation", "Eye Irritation", "up"), ("ocular toxicity", "Eye Irritation", "up"),
    ("respiratory toxicity", "Respiratory", "up"), ("lung toxicity", "Respiratory", "up"),
    ("metabolic instability", "HLM Stability", "down"), ("metabolism issues", "HLM Stability", "down"),
    ("metabolism", "HLM Stability", "down"), ("synthesis difficulty", "SAScore", "up"),
    ("hard to synthesize", "SAScore", "up"), ("drug-likeness", "QED", "down"), ("desirability", "QED", "down"),
    ("dili risk", "DILI", "up"), ("liver injury risk", "DILI", "up"), ("hepatotoxicity risk", "DILI", "up"),
    ("genotoxicity risk", "Genotoxicity", "up"), ("mutagenicity risk", "Genotoxicity", "up"),
    ("ames positive", "AMES Toxicity", "up"), ("neurotoxicity risk", "Toxicity: Drug-induced Neurotoxicity", "up"),
    ("cns toxicity risk", "Toxicity: Drug-induced Neurotoxicity", "up"),
    ("human hepatotoxicity", "Human Hepatotoxicity", "up"), ("liver toxicity", "Human Hepatotoxicity", "up"),
    ("hepatotoxicity risk", "Human Hepatotoxicity", "up"), ("liver injury risk", "Human Hepatotoxicity", "up"),
    ("bioactivation", "DILI", "up"), ("metabolic soft spot", "DILI", "up"),
    ("metabolically stable", "HLM Stability", "up"), ("aromaticity", "logP", "up"), ("planarity", "logP", "up"),
    ("polarity", "logS", "up"), ("hydrogen bond", "logS", "up"), ("hydrogen bonding", "logS", "up"),
    ("肝毒性", "DILI", "up"), ("肝损伤", "DILI", "up"), ("药物性肝损伤", "DILI", "up"), ("药物性肝毒性", "DILI", "up"),
    ("hepatotoxic", "DILI", "up"), ("liver damage", "DILI", "up"), ("hepatic injury", "DILI", "up"),
    ("hepatic toxicity", "DILI", "up"), ("liver safety", "DILI", "up"), ("hepatotoxic risk", "DILI", "up"),
    ("liver injury risk", "DILI", "up"), ("hepatotoxicity concern", "DILI", "up"),
    ("liver toxicity concern", "DILI", "up"), ("hepatotoxic potential", "DILI", "up"),
    ("liver toxicity potential", "DILI", "up"), ("代谢稳定性", "HLM Stability", "down"),
    ("代谢不稳定性", "HLM Stability", "down"), ("bsep", "Pgp inhibitor", "up"), ("oatp", "Pgp inhibitor", "up"),
    ("oatp1b1", "Pgp inhibitor", "up"), ("oatp1b3", "Pgp inhibitor", "up"), ("efflux transporter", "Pgp inhibitor", "up"),
    ("transporter inhibition", "Pgp inhibitor", "up"), ("代谢清除", "HLM Stability", "down"),
    ("metabolic clearance", "HLM Stability", "down"), ("metabolic stability", "HLM Stability", "up"),
    ("metabolism stability", "HLM Stability", "up"), ("hepatic metabolism", "HLM Stability", "down"),
    ("liver metabolism", "HLM Stability", "down"), ("oxidative metabolism", "HLM Stability", "down"),
    ("metabolic activation", "HLM Stability", "down"), ("渗透性", "Caco-2 Permeability", "down"),
    ("渗透性不足", "Caco-2 Permeability", "down"), ("渗透性问题", "Caco-2 Permeability", "down"),
    ("intestinal permeability", "Caco-2 Permeability", "down"), ("membrane permeability", "Caco-2 Permeability", "down"),
    ("passive permeability", "Caco-2 Permeability", "down"), ("absorption", "Caco-2 Permeability", "down"),
    ("bioavailability", "Caco-2 Permeability", "down"), ("molecular weight", "Molecular Weight (MW)", "down"),
    ("molecular mass", "Molecular Weight (MW)", "down"), ("high molecular weight", "Molecular Weight (MW)", "down"),
    ("large molecule", "Molecular Weight (MW)", "down"), ("heavy molecule", "Molecular Weight (MW)", "down"),
    ("hydrogen bond donors", "nHD", "down"), ("hbd", "nHD", "down"), ("hydrogen bond acceptors", "nHA", "down"),
    ("hba", "nHA", "down"), ("lipophilicity", "logP", "down"), ("hydrophobicity", "logP", "down"),
    ("high logp", "logP", "down"), ("low logp", "logP", "up"), ("分子量", "Molecular Weight (MW)", "down"),
    ("氢键供体", "nHD", "down"), ("氢键受体", "nHA", "down"), ("亲脂性", "logP", "down"), ("疏水性", "logP", "down"),
    ("水溶性", "logS", "up"), ("渗透性", "Caco-2 Permeability", "down"), ("代谢稳定性", "HLM Stability", "up"),
    ("代谢不稳定性", "HLM Stability", "down"),
)


#: Further names of features, beside those that follow by rule. Where several features list a name, the last
#: of them in the order of FEATURES has it. This is not every name in use: a full table is the caller's (resolve_aliases).
ALIASES = (
    ("10肽", ("ten peptides",)),
    ("Alarm_NMR Rule", ("警报 nmr 规则",)),
    ("Acute Toxicity Rule", ("急性毒性 规则",)),
    ("AMES Toxicity", ("ames", "艾姆斯 毒性", "mutagenicity", "mutagenic", "ames test")),
    ("Aquatic Toxicity Rule", ("水生毒性 规则",)),
    ("A549 Cytotoxicity", ("a549 细胞毒性",)),
    ("BCF", ("生物富集因子",)),
    ("BCRP inhibitor", ("bcrp", "bcrp 抑制剂")),
    ("BBB", ("blood brain barrier", "血脑屏障", "blood-brain barrier")),
    ("Boiling point", ("沸点",)),
    ("Caco-2 Permeability", ("caco2", "caco-2", "caco2 permeability", "permeability")),
    ("Carcinogenicity", ("致癌性", "carcinogenic")),
    ("Chelating Rule", ("螯合 规则",)),
    ("CL_plasma", ("cl plasma", "cl<sub>plasma</sub>", "血浆 清除率", "plasma clearance")),
    ("CYP2D6 inhibitor", ("抑制 cyp2d6", "cyp2d6/抑制")),
    ("DILI", ("drug-induced liver injury", "药物性 肝损伤", "药物 诱导 肝损伤", "hepatotoxicity", "liver injury", "hepatic injury")),
    ("Density", ("密度",)),
    ("Eye Corrosion", ("眼腐蚀",)),
    ("Eye Irritation", ("眼刺激",)),
    ("FDAMDD", ("fda 最大推荐剂量", "fda mdd")),
    ("FLuc inhibitors", ("荧光素酶 抑制剂",)),
    ("Flexibility", ("柔性", "rotatable bonds")),
    ("Fsp3", ("fsp³", "fsp 3", "fsp<sup>3</sup>")),
    ("Fu", ("血浆 游离分数", "fraction unbound")),
    ("GoldenTriangle", ("金三角规则", "golden triangle")),
    ("Genotoxic Carcinogenicity Mutagenicity Rule", ("遗传毒性 规则",)),
    ("Genotoxicity", ("遗传毒性", "genotox", "genotoxic", "mutagenicity", "mutagenic")),
    ("Green fluorescence", ("绿色荧光",)),
    ("HBD (nHD)", ("hbd", "nhd", "氢供体")),
    ("HBA (nHA)", ("hba", "nha", "氢受体")),
    ("Hek293 Cytotoxicity", ("hek293 细胞毒性",)),
    ("HIA", ("human intestinal absorption", "人肠道吸收")),
    ("HLM Stability", ("代谢 稳定性", "人肝微粒体 稳定性", "代谢 不稳定性", "分子 不稳定性", "metabolic stability")),
    ("Human Hepatotoxicity", ("人类 肝毒性", "liver toxicity", "hepatotoxicity", "liver injury")),
    ("IG C50", ("igc50",)),
    ("logD7.4", ("logd 7.4", "logd_7_4")),
    ("logP", ("clogp", "lipophilicity")),
    ("logS", ("溶解度", "solubility")),
    ("MDCK Permeability", ("mdck",)),
    ("Melting point", ("熔点",)),
    ("Molecular Weight (MW)", ("molecular weight", "分子量")),
    ("NPscore", ("np 分数",)),
    ("NonBiodegradable", ("非 生物 降解",)),
    ("NonGenotoxic Carcinogenicity Rule", ("非 遗传毒性 规则",)),
    ("nHet", ("杂原子数",)),
    ("nHD", ("氢供体 数",)),
    ("nHA", ("氢受体 数",)),
    ("nRing", ("环数",)),
    ("nRig", ("刚性 数",)),
    ("nRot", ("旋转键 数", "roam")),
    ("NR-Aromatase", ("nr-芳构酶",)),
    ("NR-PPAR-gamma", ("nr-ppar-γ",)),
    ("PPB", ("plasma protein binding", "血浆 蛋白 结合率")),
    ("Promiscuous compounds", ("非特异性 配体",)),
    ("QED", ("药物 相似度", "drug-likeness")),
    ("Rat Oral Acute Toxicity", ("大鼠 口服 急性毒性",)),
    ("Respiratory", ("呼吸毒性",)),
    ("RPMI-8226 Immunitoxicity", ("rpmi-8226 免疫毒性",)),
    ("Reactive compounds", ("活性化合物",)),
    ("SAscore", ("合成可及性 分数", "synthesizability")),
    ("Skin Sensitization", ("皮肤 致敏性",)),
    ("Skin Sensitization Rule", ("皮肤 致敏性 规则",)),
    ("Stereo Centers", ("立体 中心",)),
    ("Topological Polar Surface Area (TPSA)", ("极性表面积",)),
    ("T1/2", ("半衰期", "half-life")),
    ("Toxicity: Eye Corrosion", ("眼腐蚀",)),
    ("Toxicity: Eye Irritation", ("眼刺激", "eye irritation")),
    ("Toxicity: Human Hepatotoxicity", ("人类 肝毒性",)),
    ("Toxicity: Drug-induced Nephrotoxicity", ("药物 诱导 肾毒性", "nephrotoxicity")),
    ("Toxicity: Drug-induced Neurotoxicity", ("药物 诱导 神经毒性", "neurotoxicity")),
    ("Toxicity: Ototoxicity", ("耳毒性",)),
    ("Toxicity: Hematotoxicity", ("血液 毒性",)),
    ("Toxicity: Genotoxicity", ("基因 毒性",)),
    ("Toxicity: Carcinogenicity", ("致癌性",)),
    ("Toxicity: Skin Sensitization", ("皮肤 致敏性",)),
    ("Toxicity: DILI", ("药物性 肝损伤", "drug-induced liver injury")),
    ("Toxicity: AMES Toxicity", ("ames 毒性", "mutagenicity", "ames test")),
    ("Toxicity: Rats Oral Acute Toxicity", ("大鼠 口服 急性毒性",)),
    ("Toxicity: FDAMDD", ("fda mdd",)),
    ("Toxicity: RPMI-8226 Immunitoxicity", ("rpmi-8226 免疫毒性",)),
    ("Toxicity: A549 Cytotoxicity", ("a549 细胞毒性",)),
    ("Toxicity: Hek293 Cytotoxicity", ("hek293 细胞毒性",)),
    ("hERG Blockers", ("herg", "herg blockade", "herg inhibition", "herg blocker")),
    ("Pgp inhibitor", ("p-gp inhibitor",)),
    ("Pgp substrate", ("p-gp substrate",)),
)


def ruled_aliases(name: str) -> list[str]:
    """Aliases of a feature by rule: the name itself; of enzymes with inhibitor or substrate the bare number too, and
    Chinese; of rules of one word Chinese; the letters in brackets."""
    low = name.lower()
    forms = [low]
    if low.startswith("cyp"):
        enzyme, kind = low.split()
        forms += [f"{enzyme[3:]} {kind}", f"{enzyme} {'抑制剂' if kind == 'inhibitor' else '底物'}"]
    if low.endswith(" rule") and low.count(" ") == 1:
        forms.append(low[: -len("rule")] + "规则")
    if low.endswith(")") and " (" in low:
        forms.append(low[low.index(" (") + 2 : -1])
    return forms


def alias_entries() -> list[tuple[str, str]]:
    """Feature and alias, by rule and of ALIASES, in the order of FEATURES."""
    more = dict(ALIASES)
    return [(name, alias) for name in FEATURES for alias in (*ruled_aliases(name), *more.get(name, ()))]


def default_aliases() -> dict[str, str]:
    """Alias to canonical name; of names that list one alias the last has it."""
    return {alias: name for name, alias in alias_entries()}
