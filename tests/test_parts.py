"""Lookups in the parts of Office packages."""

from __future__ import annotations

import random
from xml.etree import ElementTree

from folioflow.sources import ooxml


def test_paths_are_found_as_the_standard_library_does():
    rng = random.Random(3)
    names = ["w:a", "w:b", "w:c"]
    for _ in range(200):
        root = ElementTree.Element("r")
        made = [root]
        for _ in range(20):
            made.append(ElementTree.SubElement(rng.choice(made), ooxml.tag(rng.choice(names))))
        path = "/".join(rng.choice(names) for _ in range(rng.randint(1, 4)))
        assert ooxml.find(root, path) is root.find(path, ooxml.NS)
