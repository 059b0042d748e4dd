"""Analytics over set-event panels: ordered periods that each draw a subset of a fixed universe."""
