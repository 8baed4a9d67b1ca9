"""The seven analytics tables from the core tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame

from faultline.operators import followup, summaries, workflow
from faultline.operators.skew import HOT_ROWS

TABLES = [
    "current_status",
    "stage_lead_times",
    "follow_up_queue",
    "bottleneck_summary",
    "asset_delay_summary",
    "zone_delay_summary",
    "spare_waiting_summary",
]


class Analytics:
    """Lazily built tables that share the lead-time records.

    Pass ``leads`` when the records are stored already, so that later tables scan them instead of redoing the event
    window; the batch run does.
    """

    def __init__(
        self,
        core: dict[str, DataFrame],
        as_of: datetime | None = None,
        leads: DataFrame | None = None,
        hot_rows: int = HOT_ROWS,
    ):
        self.core = core
        self.hot_rows = hot_rows
        self._as_of = as_of
        self._leads = leads
        self._status: DataFrame | None = None

    @property
    def as_of(self) -> Column:
        return workflow.as_of_column(self.core["events"], self._as_of)

    @property
    def leads(self) -> DataFrame:
        if self._leads is None:
            self._leads = workflow.lead_times(self.core["events"], self._as_of, self.hot_rows)
        return self._leads

    def current_status(self) -> DataFrame:
        if self._status is None:
            self._status = workflow.current_status(
                self.core["incidents"], self.core["assets"], self.leads, self.core["work_orders"], self.as_of
            )
        return self._status

    def use_status(self, status: DataFrame) -> None:
        """Read the current status from its stored table from here on."""
        self._status = status

    def stage_lead_times(self) -> DataFrame:
        return workflow.lead_time_table(self.leads)

    def scored_incidents(self) -> DataFrame:
        c = self.core
        return followup.scored_incidents(
            c["incidents"],
            c["assets"],
            c["zones"],
            self.leads,
            self.current_status(),
            c["work_orders"],
            c["spares"],
            c["snapshots"],
            self.as_of,
        )

    def follow_up_queue(self) -> DataFrame:
        return followup.follow_up_queue(self.scored_incidents())

    def bottleneck_summary(self) -> DataFrame:
        c = self.core
        return summaries.bottleneck_summary(
            self.leads,
            c["incidents"],
            c["assets"],
            c["zones"],
            c["work_orders"],
            c["spares"],
            self.as_of,
            self.hot_rows,
        )

    def asset_delay_summary(self) -> DataFrame:
        c = self.core
        return summaries.asset_delay_summary(
            c["incidents"], c["assets"], c["zones"], self.leads, self.current_status()
        )

    def zone_delay_summary(self) -> DataFrame:
        c = self.core
        return summaries.zone_delay_summary(c["incidents"], c["assets"], c["zones"], self.leads, self.current_status())

    def spare_waiting_summary(self) -> DataFrame:
        c = self.core
        return summaries.spare_waiting_summary(self.leads, c["incidents"], c["work_orders"], c["spares"])

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)()
