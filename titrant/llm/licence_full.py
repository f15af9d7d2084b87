"""Whole licence files, in the wordings and with the titles in common use."""

from __future__ import annotations

from importlib.resources import files

from titrant.llm.licence_texts import KNOWN

#: Titles that files of the short licences carry above the text.
TITLES = {
    "MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)", "MIT", "Expat License", "The Expat License"],
    "ISC": ["", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "0BSD": ["", "BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD License", "0BSD", "BSD 0-Clause License"],
    "BSD-2-Clause": ["", "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", 'BSD 2-Clause "Simplified" License',
                     "Simplified BSD License", "The Simplified BSD License", "FreeBSD License", "The FreeBSD License", "BSD License", "The BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["", "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License',
                     "New BSD License", "The New BSD License", "Revised BSD License", "Modified BSD License", "BSD License", "The BSD License", "BSD-3-Clause"],
}


def _wordings() -> dict[str, list[str]]:
    """Texts of the short licences without their titles."""
    plain = lambda t: t.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ")
    isc = KNOWN["ISC"].split("\n\n", 2)[2]
    older = lambda t: t.replace("and/or distribute", "and distribute")
    return {
        "MIT": [KNOWN["MIT (grant)"]], "ISC": [isc, older(isc)], "0BSD": [KNOWN["0BSD"], older(KNOWN["0BSD"])],
        **{name: [KNOWN[name], plain(KNOWN[name])] for name in ("BSD-2-Clause", "BSD-3-Clause")},
    }


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of every wording under every title, and of the long licences."""
    out = [(name, f"{title}\n\n{text}") for name, texts in _wordings().items() for text in texts for title in TITLES[name]]
    for file in sorted(files("titrant.llm").joinpath("licence_files").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
            texts = [text]
            if name == "Apache-2.0":  # often without the appendix on how to apply it
                head, end, _ = text.partition("END OF TERMS AND CONDITIONS")
                texts += [head, head + end]
            out += [(name, form) for t in texts for form in {t, t.replace("https://", "http://"), t.replace("http://", "https://")}]
    return out
