"""Event files as JSON: a list of {particles: [...], collections: {name: [hit, ...]}}."""

import json
from types import SimpleNamespace


class Part:
    """Values under the names of getters."""

    def __init__(self, **values):
        for name, value in values.items():
            setattr(self, name, lambda value=value: value)


def vector(v):
    return SimpleNamespace(x=v[0], y=v[1], z=v[2])


def particle(p):
    return Part(isCreatedInSimulation=p["created"], getPDG=p["pdg"], getVertex=vector(p["vertex"]), getMomentum=vector(p["momentum"]))


def hit(h):
    parts = [Part(getStepPosition=vector(c[:3]), getEnergy=c[3], getTime=c[4], getPDG=c[5], getParticle=Part(getObjectID=SimpleNamespace(index=c[6]))) for c in h["parts"]]
    return Part(getCellID=h["cell"], getContributions=parts)


class Frame:
    def __init__(self, event):
        self.event = event

    def get(self, name):
        if name == "MCParticles":
            return [particle(p) for p in self.event["particles"]]
        if name not in self.event["collections"]:
            raise KeyError(name)
        return [hit(h) for h in self.event["collections"][name]]


class Reader:
    def __init__(self, path):
        with open(path) as file:
            self.events = json.load(file)

    def get(self, _):
        return [Frame(e) for e in self.events]
