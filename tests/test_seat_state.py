"""The state of positions: one value a company."""

from __future__ import annotations

from pyspark.sql import Row

from actaflow.streaming import positions


def test_a_company_takes_one_read_and_one_write_a_batch():
    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    class Handle:
        timers = []

        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, at):
            self.timers.append(at)

    machine = positions.Seats()
    machine.init(Handle())
    columns = "day_no event_id holder person role label kind opens seat form".split()
    rows = [Row(**dict(zip(columns, (i % 40, i, f"P {i}", f"P {i}", "board_member", "Consejero", "appointment", True, "", 0)))) for i in range(500)]
    for part in (rows[::2], rows[1::2]):
        told = list(machine.handleInputRows((1,), iter(part), None))
        assert len(told) == 250 and all(r.held for r in told)
    assert machine.company.calls == 4 and len(Handle.timers) == 1
